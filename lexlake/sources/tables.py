"""Tables in Parquet: created or verified, written idempotently, appended to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingestion import latest_wins


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, by: list[str] | None = None, recreate: bool = False) -> None:
    """An empty table where there is none; one with another schema raises, it never drifts."""
    if not recreate:
        try:
            have = spark.read.parquet(path).schema
        except AnalysisException:
            pass
        else:
            if {(f.name, f.dataType) for f in have} != {(f.name, f.dataType) for f in schema}:
                raise ValueError(f"{path}: another schema")
            return
    spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def upsert(spark: SparkSession, path: str, version: str, changes: DataFrame, keys: list[str]) -> str:
    """Writes the table at `path` with the changes as a new version beside it and returns its path: readers of the old
    one are not disturbed, and running it again gives the same rows."""
    out = f"{path.rstrip('/')}-{version}"
    latest_wins(spark.read.parquet(path), changes, keys).write.mode("overwrite").parquet(out)
    return out


def append_feedback(rows: DataFrame, path: str) -> None:
    """Rows with empty citations and configuration where they are missing."""
    filled = rows.withColumns({"citations": F.coalesce("citations", F.lit("[]")), "config": F.coalesce("config", F.lit("{}"))})
    filled.write.mode("append").parquet(path)


def current_runs(log: DataFrame) -> DataFrame:
    """The last state of each run of an append-only log (id, at, status, errors, note); an interrupt's note is an error without a file."""
    last = log.groupBy("id").agg(F.max_by(F.struct("status", "errors", "note"), "at").alias("r")).select("id", "r.*")
    note = F.array(F.struct(F.lit(None).cast("string").alias("file_path"), F.col("note").alias("error")))
    errors = F.coalesce("errors", F.expr("cast(array() as array<struct<file_path:string,error:string>>)"))
    return last.select("id", "status", F.when(F.col("note").isNotNull(), F.concat(errors, note)).otherwise(errors).alias("errors"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of an older version under a newer schema: new columns are null, old ones cast; a column that the new one lacks
    raises, as nothing is dropped silently."""
    gone = [c for c in df.columns if c not in schema.names]
    if gone:
        raise ValueError(f"columns that the new schema lacks: {', '.join(gone)}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

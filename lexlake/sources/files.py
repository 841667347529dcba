"""Documents from files: a folder level of collections, text files below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, root: str, collections: list[str] | None = None, pattern: str = "*.md") -> DataFrame:
    """(rel_path, collection, name, content, length): hidden folders skipped; a collection that isn't there raises.

    Without content selected only the listing is read. Order by collection, name for the deterministic walk.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_extract("path", r"([^/]+)/([^/]+)$", 0)
    rows = found.select(tail.alias("rel_path"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("collection"), F.substring_index("path", "/", -1).alias("name"), "content", "length").where(~F.startswith("collection", F.lit(".")))
    if collections is None:
        return rows
    there = {r.collection for r in rows.select("collection").distinct().where(F.col("collection").isin(collections)).collect()}
    if missing := sorted(set(collections) - there):
        raise ValueError(f"no such collection: {', '.join(missing)}")
    return rows.where(F.col("collection").isin(collections))


def decoded(content: Column) -> Column:
    """UTF-8 up to the first NUL, broken bytes replaced."""
    return F.substring_index(F.make_valid_utf8(content.cast("string")), "\x00", 1)


def payload(text: Column) -> tuple[Column, Column]:
    """(format, text): base64 of an HTML page is decoded, a corrupt one stays as it is."""
    bare = F.regexp_replace(text, r"\s+", "")
    is_html = F.startswith(bare, F.lit("PGh0bWw")) | F.startswith(bare, F.lit("PEhUTUw"))
    whole = F.substr(bare, F.lit(1), F.length(bare) - F.length(bare) % 4)
    html = F.when(is_html, F.make_valid_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string")))
    return F.when(html.isNotNull(), "akn-html").otherwise("markdown"), F.coalesce(html, text)


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows under a fixed schema; missing columns or other types raise instead of drifting."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"schema mismatch: {', '.join(wrong)}")
    return df.select(*schema.names)


EVAL_KINDS = ("explicit", "natural", "lay", "trap")


def evaluation_set(df: DataFrame) -> DataFrame:
    """Evaluation queries; a kind outside the closed set fails the job that reads it."""
    ok = F.col("kind").isin(*EVAL_KINDS)
    return df.withColumn("kind", F.when(ok, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("null"))))))


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A table whose readers prune by a column. Rows of a value are dealt together; adaptive execution cuts large values into
    several files and joins small ones, by their size."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)

"""Tables between the steps of one computation, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster sets. Only a local session may leave it unset: all its
    tasks share one machine, whose temporary folder then serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            base = java.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="checkpoints")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base.rstrip('/')}/lexlake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation above."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

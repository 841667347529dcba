"""Change feeds in batches, and alerts with a memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import read_or_empty

#: Seconds for which an alert that was sent isn't repeated.
QUIET = 86_400
SENT = "key string, at long"


def run_feed(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies what a stream of changes holds, once, and stops: batches go by the checkpoint's cursor, not by event time. A
    batch whose application failed comes again under its number, so apply(batch, number) has to write by that number."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_alerts(alerts: DataFrame, sent: DataFrame, quiet: int = QUIET) -> DataFrame:
    """Alerts (key, at in seconds, message), the first of each key, unless one of it was sent less than `quiet` seconds ago."""
    last = sent.groupBy("key").agg(F.max("at").alias("last"))
    first = alerts.groupBy("key").agg(F.min_by(F.struct("at", "message"), "at").alias("a")).select("key", "a.*")
    return first.join(last, "key", "left").where(F.col("last").isNull() | (F.col("at") - F.col("last") >= quiet)).select("key", "at", "message")


def push_alerts(spark: SparkSession, alerts: DataFrame, state: str, send: Callable[[str, str], bool], quiet: int = QUIET) -> int:
    """Sends what is due, by a function of (key, message) that says whether it got through, and remembers those that did in
    the table at `state`; returns how many. There is an alert for each key at most, so few rows reach the driver."""
    rows = due_alerts(alerts, read_or_empty(spark, state, SENT), quiet).orderBy("key").collect()
    done = [(r.key, r.at) for r in rows if send(r.key, r.message)]
    if done:
        spark.createDataFrame(done, SENT).coalesce(1).write.mode("append").parquet(state)
    return len(done)

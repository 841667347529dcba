"""Admission limits and repeated alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_admission(events: DataFrame, who: str, ts: Column, order: str, most: int) -> DataFrame:
    """Whether each event is within the first `most` of its identity's local day."""
    day = F.to_date(ts)
    w = Window.partitionBy(who, "day").orderBy(ts, order)
    return events.withColumn("day", day).withColumn("place", F.row_number().over(w)).withColumn("admitted", F.col("place") <= most)


def peak_concurrency(starts: DataFrame, who: str, begin: Column, end: Column) -> DataFrame:
    """Most intervals open at once, by identity: a start counts +1, an end -1, ends first at equal times."""
    each = starts.select(who, F.explode(F.array(F.struct(begin.alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))).alias("e")).select(who, "e.*")
    moments = each.groupBy(who, "at", "step").agg(F.sum("step").alias("n"))
    w = Window.partitionBy(who).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    return moments.withColumn("open", F.sum("n").over(w)).groupBy(who).agg(F.max("open").alias("peak"))


def sent_alerts(events: DataFrame, key: str, seconds: Column, ok: Column, quiet: int) -> DataFrame:
    """(key, at) of the alerts sent: one only if the last successful one is `quiet` seconds or more ago.

    Each decision rests on the last: a fold over a key's times, inside the JVM.
    """
    times = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seconds.cast("long").alias("at"), ok.alias("ok")))).alias("times"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.expr("cast(array() as array<bigint>)").alias("sent"))

    def step(acc: Column, x: Column) -> Column:
        due = acc["last"].isNull() | (x["at"] - acc["last"] >= quiet)
        send = due & x["ok"]
        return F.struct(F.when(send, x["at"]).otherwise(acc["last"]).alias("last"), F.when(send, F.concat(acc["sent"], F.array(x["at"]))).otherwise(acc["sent"]).alias("sent"))

    return times.select(key, F.explode(F.aggregate("times", start, step, lambda a: a["sent"])).alias("at"))


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, key: str) -> DataFrame:
    """Counts and sums by event-time window; on a stream, late rows are dropped after the watermark."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))

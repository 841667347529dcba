"""A sink of lots: chunks in order, a fixed number at a time, to a store that acknowledges; what it has acknowledged is never sent again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored
from .tables import read_or_empty

#: Rows of a lot, seconds to wait before further attempts, lots that a job sends.
LOT, BACKOFF, WAVE = 256, (5, 20), 4096
LOG = "lot long, n long, attempts int, error string"
_ACKS = pa.schema([("lot", pa.int64()), ("n", pa.int64()), ("attempts", pa.int32()), ("error", pa.string())])


def in_lots(rows: DataFrame, order: list[Column], size: int = LOT) -> DataFrame:
    """The rows with `lot`, from 0 on: rows in order, `size` to a lot.

    Rows are dealt into ranges of the order; a row's place is what the ranges before its own hold and its number within. The one
    window over all has a row for each range.
    """
    names = [f"_o{k}" for k in range(len(order))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *(c.alias(name) for c, name in zip(order, names, strict=True)))
    ranged = stored(keyed.repartitionByRange(n, *names).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*names)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn("lot", F.floor((F.col("_place") + F.col("_before")) / size).cast("long")).drop("_range", "_place", "_before", *names)


def durable(spark: SparkSession, log: str) -> DataFrame:
    """(lot) of the lots that the store has acknowledged."""
    return read_or_empty(spark, log, LOG).where("error is null").select("lot").distinct()


def last_durable(spark: SparkSession, log: str) -> int:
    """The last lot up to which all are durable, -1 if the first isn't."""
    lots = durable(spark, log)
    ends = lots.join(lots.select((F.col("lot") - 1).alias("lot")), "lot", "left_anti")
    # Lots without a next one: the smallest ends the run that starts at 0.
    return -1 if lots.where("lot = 0").isEmpty() else ends.agg(F.min("lot")).first()[0]


def send_lots(rows: DataFrame, send: Callable[[list[dict]], None], log: str, backoff: tuple[float, ...] = BACKOFF, wave: int = WAVE) -> tuple[int, int]:
    """Sends rows (lot and the rest, as dicts) lot by lot; returns (rows sent, rows skipped, as their lot was durable).

    send(rows of a lot) returns once the store holds them, and raises otherwise; it is tried again after each wait of `backoff`. Lots are sent by the tasks,
    `wave` of them in a job, and a job's acknowledgements are added to the table at `log` before the next begins. A lot that fails
    to the end doesn't stop the others of its wave; then this raises, and calling it again sends what isn't durable. Ids must make
    sending twice harmless, as a lost task sends its lots again.
    """
    columns = [c for c in rows.columns if c != "lot"]
    spark = rows.sparkSession
    rows = stored(rows)
    known = durable(spark, log)
    n_all = rows.count()
    left = stored(rows.join(known, "lot", "left_anti"))

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                lot, some = held[0]["lot"], [{c: r[c] for c in columns} for r in held]
                attempts, error = _attempted(send, some, backoff)
                yield pa.RecordBatch.from_pylist([{"lot": lot, "n": len(some), "attempts": attempts, "error": error}], schema=_ACKS)
                held.clear()

        for batch in got:
            for row in batch.to_pylist():
                if held and held[0]["lot"] != row["lot"]:
                    yield from flush()
                held.append(row)
        yield from flush()

    first, last = left.agg(F.min("lot"), F.max("lot")).first()
    if first is None:
        return 0, n_all
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for begin in range(first, last + 1, wave):
        some = left.where(F.col("lot").between(begin, begin + wave - 1))
        acks = stored(some.repartition(n, "lot").sortWithinPartitions("lot").mapInArrow(run, LOG))
        acks.write.mode("append").parquet(log)
        failed = acks.where("error is not null").orderBy("lot").limit(1).collect()
        if failed:
            raise RuntimeError(f"lot {failed[0].lot} failed {failed[0].attempts} times ({failed[0].error}); durable up to lot {last_durable(spark, log)}, call again to go on")
    return left.count(), n_all - left.count()


def _attempted(send: Callable[[list[dict]], None], rows: list[dict], backoff: tuple[float, ...]) -> tuple[int, str | None]:
    error = None
    for attempt, wait in enumerate((0, *backoff), 1):
        time.sleep(wait)
        try:
            send(rows)
            return attempt, None
        except Exception as e:  # whatever the store's client raises is this lot's result
            error = f"{type(e).__name__}: {e}"[:200]
    return attempt, error

"""Admission on a stream and over long chains, against one request after the other."""

import datetime
import random
import time

from test_extras import admitted_by_hand

from lexlake.streaming import admission

SCHEMA = "id long, ts timestamp, done timestamp, ip string, cookie string"
BEGIN = datetime.datetime(2024, 3, 30, 18)


def requests(n, seed, step=60):
    """In order of time, over some local midnights, many of one moment."""
    draw = random.Random(seed)
    at, rows = BEGIN, []
    for i in range(n):
        at += datetime.timedelta(seconds=draw.choice([0, 0, step, 20 * step]))
        rows.append((i, at, None if draw.random() < 0.2 else at + datetime.timedelta(seconds=draw.randint(0, 4) * 200), draw.choice(["a", "b", "c", None]) if i % 3 else "hot", f"c{draw.randint(0, 12)}"))
    return rows


def test_batches_of_a_stream(spark, tmp_path):
    """The same verdicts as of all requests at once; a batch that is done again after a failure leaves them as they were."""
    rows = requests(360, 3)
    source, folder = tmp_path / "source", str(tmp_path / "out")
    for k in range(0, 360, 120):
        spark.createDataFrame(rows[k : k + 120], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        writer = admission.admit_stream(stream, folder, 8, 2, "Europe/Rome", 900).option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.verdict for r in spark.read.parquet(f"{folder}/verdicts").collect()}
    want = admitted_by_hand(rows, 8, 2, "Europe/Rome", 900)
    assert got == want and len({*want.values()}) == 3
    last = {r.who: r.n for r in spark.read.parquet(f"{folder}/state-2").collect()}
    again, _ = admission.decide(spark.createDataFrame(rows[240:], SCHEMA), spark.read.schema(admission.STATE).parquet(f"{folder}/state-1"), 8, 2, "Europe/Rome", 900)
    assert {r.id: r.verdict for r in again.collect()} == {i: want[i] for i in range(240, 360)}
    assert len(last) <= 4 + 1 + 13


def test_a_chain_is_linear(spark):
    """Each verdict hangs on the one before: ten thousand of them in one pass."""
    rows = [(i, BEGIN + datetime.timedelta(seconds=i), BEGIN + datetime.timedelta(seconds=i + 2), f"ip{i // 2}", f"c{(i + 1) // 2}") for i in range(10_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.time()
    got = {r.id: r.verdict for r in admission.admit(df, 100, 1).collect()}
    took = time.time() - began
    assert got == admitted_by_hand(rows, 100, 1, "UTC", 300)
    assert took < 120


def test_groups_end_with_the_day(spark):
    """Identities that meet on other days, further apart than a request can last, are in groups of their own."""
    far = [(k, BEGIN + datetime.timedelta(days=k, hours=1), None, "a", f"c{k}") for k in range(5)]
    near = [(10, datetime.datetime(2024, 5, 1, 23, 59), None, "z", "y"), (11, datetime.datetime(2024, 5, 2, 0, 1), None, "z", "x")]
    df = spark.createDataFrame(far + near, SCHEMA)
    grouped, _ = admission._grouped(admission._timed(df, "UTC", 300), spark.createDataFrame([], admission.STATE), 300)
    group = {r.id: r.group for r in grouped.collect()}
    assert len({group[k] for k in range(5)}) == 5 and group[10] == group[11]
    assert {r.id: r.verdict for r in admission.admit(df, 9, 1).collect()}[11] == "concurrency_limit"


def test_no_requests(spark):
    verdicts, state = admission.decide(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("ip:a", 3, 2, [5], 9)], admission.STATE), 1, 1)
    assert verdicts.collect() == [] and state.count() == 1

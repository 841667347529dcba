"""Prose references, feeds, events, admission, batches and tables."""

import datetime
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.operators.embedding import embed, model_named, token_batches
from lexlake.operators.identity import citation_label
from lexlake.sources import changes, tables
from lexlake.sources.files import write_partitioned
from lexlake.streaming import admission, feeds
from lexlake.streaming.events import EventReader, turn_events


def test_name_status():
    raw = "M\0A a/1.md\0R100\0a/2.md\0b/2.md\0R090\0a/3.md\0b/3.md\0D\0a/4.md\0C080\0a/5.md\0b/5.md\0A\0readme.md\0T\0a/6.md\0"
    assert list(changes.name_status(raw)) == [("upsert", "A a/1.md", None), ("move", "b/2.md", "a/2.md"), ("delete", "a/3.md", None), ("upsert", "b/3.md", None), ("delete", "a/4.md", None), ("upsert", "b/5.md", None), ("upsert", "a/6.md", None)]


def test_event_reader_at_any_cut():
    text = ': hi\nevent: token\ndata: {"t": 1}\n\nevent: odd\ndata: 1\n\r\nevent: done\ndata: {\ndata: }\n\nevent: token\ndata: broken\n\n'
    want = [("token", {"t": 1}), ("done", {})]
    draw = random.Random(1)
    for _ in range(30):
        reader, got, at = EventReader(), [], 0
        while at < len(text):
            n = draw.randint(1, 7)
            got += reader.feed(text[at : at + n])
            at += n
        assert got == want


def admitted_by_hand(rows, day_most, open_most, zone, ttl):
    """One request after the other."""
    day, running, out = {}, {}, {}
    for i, ts, done, *who in sorted(rows, key=lambda r: (r[1], r[0])):
        today = ts.replace(tzinfo=datetime.UTC).astimezone(ZoneInfo(zone)).date()
        end = min(done or datetime.datetime.max, ts + datetime.timedelta(seconds=ttl))
        who = [(k, w) for k, w in enumerate(who)]
        for w in who:
            running[w] = [e for e in running.get(w, []) if e > ts]
        if any(day.get((w, today), 0) >= day_most for w in who):
            out[i] = "daily_limit"
        elif any(len(running[w]) >= open_most for w in who):
            out[i] = "concurrency_limit"
        else:
            out[i] = "admitted"
            for w in who:
                day[w, today] = day.get((w, today), 0) + 1
                running[w].append(end)
    return out


def test_admission_by_hand(spark):
    draw = random.Random(2)
    begin = datetime.datetime(2024, 3, 30, 18)
    rows = []
    for i in range(400):
        ts = begin + datetime.timedelta(seconds=draw.randint(0, 40) * 1800)
        rows.append((i, ts, None if draw.random() < 0.2 else ts + datetime.timedelta(seconds=draw.randint(0, 4) * 900), f"ip{draw.randint(0, 5)}", f"c{draw.randint(0, 9)}"))
    df = spark.createDataFrame(rows, "id long, ts timestamp, done timestamp, ip string, cookie string")
    got = admission.admit(df, 4, 2, "Europe/Rome", 3600).collect()
    want = admitted_by_hand(rows, 4, 2, "Europe/Rome", 3600)
    assert {r.id: r.verdict for r in got} == want and len({*want.values()}) == 3
    for r in got:
        assert (r.retry_after is None) == (r.verdict == "admitted") and (r.verdict != "concurrency_limit" or r.retry_after == 5)


def test_daily_limit_comes_first(spark):
    at = datetime.datetime(2024, 1, 1, 22, 30)
    rows = [(1, at, None, "a", "x"), (2, at + datetime.timedelta(seconds=1), None, "a", "y"), (3, at + datetime.timedelta(hours=2), None, "b", "x"), (4, at, None, None, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, done timestamp, ip string, cookie string")
    got = {r.id: (r.verdict, r.retry_after) for r in admission.admit(df, 1, 1, "Europe/Rome").collect()}
    assert got[1] == ("admitted", None) and got[2] == ("daily_limit", 30 * 60 - 1) and got[3] == ("admitted", None) and got[4] == ("admitted", None)


def test_visitors_and_addresses(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2 ", "0123456789abcdef0123456789ABCDEF"), ("", "x"), (None, None)], "h string, c string")
    v, new = admission.visitor_id(F.col("c"), F.lit("fresh"))
    got = df.select(admission.rightmost_address(F.col("h"), F.lit("peer")).alias("a"), v.alias("v"), new.alias("n")).collect()
    assert [tuple(r) for r in got] == [("2.2.2.2", "0123456789abcdef0123456789ABCDEF", False), ("peer", "fresh", True), ("peer", "fresh", True)]


def test_batches(spark):
    got = list(token_batches(["x" * n for n in (10, 10, 300, 10, 10)], count=len, most=2, budget=100))
    assert [[len(t) for t in b] for b in got] == [[10, 10], [300], [10, 10]]
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    assert [len(r.embedding) for r in embed(df, "t").collect()] == [64, 64]


def test_tables(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, v string")
    path = str(tmp_path / "t")
    tables.ensure_table(spark, path, schema)
    tables.ensure_table(spark, path, schema)
    with pytest.raises(ValueError):
        tables.ensure_table(spark, path, T.StructType.fromDDL("k long, v int"))
    one = tables.upsert(spark, path, "1", spark.createDataFrame([(1, "a"), (2, "b")], schema), ["k"])
    two = tables.upsert(spark, one, "2", spark.createDataFrame([(2, None), (3, "c")], schema), ["k"])
    assert sorted(map(tuple, spark.read.parquet(two).collect())) == [(1, "a"), (2, None), (3, "c")]
    log = spark.createDataFrame([(1, 1, "running", None, None), (1, 2, "failed", None, "interrupted")], "id long, at long, status string, errors array<struct<file_path:string,error:string>>, note string")
    (row,) = tables.current_runs(log).collect()
    assert row.status == "failed" and row.errors[0].error == "interrupted" and row.errors[0].file_path is None


def test_migrated(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = tables.migrated(old, T.StructType.fromDDL("k long, v string, w double"))
    assert new.dtypes == [("k", "bigint"), ("v", "string"), ("w", "double")] and tuple(new.first()) == (1, "a", None)
    with pytest.raises(ValueError):
        tables.migrated(old, T.StructType.fromDDL("k long"))


def test_alerts_are_remembered(spark, tmp_path):
    state, got = str(tmp_path / "sent"), []
    alerts = lambda at: spark.createDataFrame([("a", at, "m"), ("a", at + 5, "later"), ("b", at, "n")], "key string, at long, message string")

    def send(key, message):
        got.append((key, message))
        return key == "a"

    assert feeds.push_alerts(spark, alerts(0), state, send) == 1 and got == [("a", "m"), ("b", "n")]
    assert feeds.push_alerts(spark, alerts(100), state, send) == 0 and got[2:] == [("b", "n")]
    assert feeds.push_alerts(spark, alerts(feeds.QUIET), state, send) == 1


def test_feed_batches(spark, tmp_path):
    rows = spark.createDataFrame([("upsert", "a/1.md", None), ("delete", "a/2.md", None)], "status string, path string, old_path string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        feeds.run_feed(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_models_by_name():
    assert model_named("hashed-64").queries(["a"]).shape == (1, 64)
    with pytest.raises(ValueError):
        model_named("none")


def test_labels(spark):
    df = spark.createDataFrame([("dlgs-81-2008", "18", "1"), ("codice-civile", "2043", None)], "r string, a string, c string")
    names = {"codice-civile": "Cod. civ."}
    assert [x[0] for x in df.select(citation_label(F.col("r"), F.col("a"), F.col("c"), names)).collect()] == ["Decreto Legislativo 81/2008, art. 18, c. 1", "Cod. civ., art. 2043"]


def test_turn_events_of_odd_streams(spark):
    parts = spark.createDataFrame([("s", 0, "marker", "[[x]]"), ("s", 1, "marker", "[[y|art.1]]"), ("t", 0, "text", "a")], "stream_id string, seq long, kind string, payload string")
    verdicts = spark.createDataFrame([("s", "[[y|art.1]]", False), ("s", "[[y|art.1]]", True), ("t", "a", True)], "stream_id string, marker string, verified boolean")
    got = {}
    for r in turn_events(parts, verdicts).orderBy("stream_id", "event_no").collect():
        got.setdefault(r.stream_id, []).append((r.event, r.payload, r.verified))
    assert got["s"] == [("status", "", None), ("sources", "", None), ("token", "[[x]]", None), ("token", "[[y|art.1]]", None), ("citation", "[[y|art.1]]", True), ("done", "", None)]
    assert [e for e, *_ in got["t"]] == ["status", "sources", "token", "done"]


def test_write_partitioned(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "case when id % 10 > 0 then 'big' else concat('s', id % 3) end as kind")
    write_partitioned(df, str(tmp_path / "t"), "kind")
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.where("kind = 'big'").count() == 900 and got.count() == 1000
    assert "PartitionFilters: [isnotnull(kind" in got.where("kind = 'big'")._jdf.queryExecution().executedPlan().toString()

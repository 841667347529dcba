"""The change source as a batch and a stream that is stopped and goes on, and the sink of lots that fails in the middle."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexlake.sources import commits, lots
from lexlake.streaming.feeds import run_feed


def commit(folder, number, *entries):
    os.makedirs(folder, exist_ok=True)
    raw = "".join("\0".join(e) + "\0" for e in entries)
    with open(f"{folder}/tmp", "w") as f:
        f.write(raw)
    os.rename(f"{folder}/tmp", f"{folder}/{number:08d}_c{number}_{1_700_000_000 + number}.diff")


def test_batch(spark, tmp_path):
    commits.register(spark)
    folder = str(tmp_path / "feed")
    read = lambda after=0: spark.read.format("commit_feed").option("path", f"file://{folder}").option("after", after).load()
    assert read().count() == 0
    commit(folder, 1, ("A", "A/1.md"), ("A", "readme.txt"))
    commit(folder, 2, ("R100", "A/1.md", "B/1.md"), ("M", "A/2.md"))
    commit(folder, 3, ("R090", "A/2.md", "A/3.md"), ("D", "C/9.md"))
    got = [tuple(r) for r in read().select("number", "commit", "status", "path", "old_path").orderBy("number", "status", "path").collect()]
    assert got == [(1, "c1", "upsert", "A/1.md", None), (2, "c2", "move", "B/1.md", "A/1.md"), (2, "c2", "upsert", "A/2.md", None), (3, "c3", "delete", "A/2.md", None), (3, "c3", "delete", "C/9.md", None), (3, "c3", "upsert", "A/3.md", None)]
    assert read(2).count() == 3
    assert tuple(commits.head(read()).first())[0] == "c3" and commits.head(read()).first().committed_at.timestamp() == 1_700_000_003
    one = {tuple(r) for r in commits.folded(read(1)).collect()}
    assert one == {("move", "B/1.md", "A/1.md"), ("delete", "A/2.md", None), ("delete", "C/9.md", None), ("upsert", "A/3.md", None)}
    # With the commit before, the moved file is new in this range: what is left of both paths.
    assert {tuple(r)[:2] for r in commits.folded(read()).collect()} == {("delete", "A/1.md"), ("upsert", "B/1.md"), ("delete", "A/2.md"), ("delete", "C/9.md"), ("upsert", "A/3.md")}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    commits.register(spark)
    folder, checkpoint, out = str(tmp_path / "feed"), str(tmp_path / "cp"), str(tmp_path / "out")
    seen = lambda: sorted((r.number, r.path) for r in spark.read.parquet(out).collect())

    def apply(batch, number):
        if os.path.exists(f"{folder}/stop"):
            raise ValueError("stopped")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        run_feed(spark.readStream.format("commit_feed").option("path", f"file://{folder}").load(), apply, checkpoint).awaitTermination()

    commit(folder, 1, ("A", "A/1.md"))
    commit(folder, 2, ("A", "A/2.md"), ("M", "A/1.md"))
    run()
    assert seen() == [(1, "A/1.md"), (2, "A/1.md"), (2, "A/2.md")]
    commit(folder, 3, ("D", "A/1.md"))
    open(f"{folder}/stop", "w").close()
    with pytest.raises(Exception, match="stopped"):
        run()
    os.remove(f"{folder}/stop")
    run()
    run()
    assert seen() == [(1, "A/1.md"), (2, "A/1.md"), (2, "A/2.md"), (3, "A/1.md")]


def test_lots_are_filled_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    got = {r.id: r.lot for r in lots.in_lots(rows, [F.col("id")], 64).collect()}
    assert got == {i: i // 64 for i in range(1000)}


def store(folder, broken):
    """A store of files by id; lots that hold a broken id are refused while the folder has a file `down`."""

    def send(rows):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{rows[0]['id']}\n")
        if os.path.exists(f"{folder}/down") and any(r["id"] in broken for r in rows):
            raise TimeoutError("no answer")
        for r in rows:
            with open(f"{folder}/{r['id']}.json", "w") as f:
                json.dump(r, f)

    return send


def test_a_sink_that_fails_goes_on(spark, tmp_path):
    folder, log = str(tmp_path), str(tmp_path / "log")
    rows = lots.in_lots(spark.range(300).select("id", F.concat(F.lit("t"), "id").alias("text")), [F.col("id")], 25)
    open(f"{folder}/down", "w").close()
    with pytest.raises(RuntimeError, match="lot 5 failed 3 times .*durable up to lot 4"):
        lots.send_lots(rows, store(folder, {130}), log, backoff=(0.01, 0.02), wave=4)
    calls = open(f"{folder}/calls").read().split()
    assert calls.count("125") == 3 and "200" not in calls
    os.remove(f"{folder}/down")
    # Lots 0 to 4, 6 and 7 are durable: of the second wave only the refused lot is left.
    assert lots.send_lots(rows, store(folder, {130}), log, backoff=(0.01, 0.02), wave=4) == (125, 175)
    again = open(f"{folder}/calls").read().split()[len(calls) :]
    assert sorted(map(int, again)) == [125, 200, 225, 250, 275]
    assert sum(name.endswith(".json") for name in os.listdir(folder)) == 300 and json.load(open(f"{folder}/130.json")) == {"id": 130, "text": "t130"}
    assert lots.last_durable(spark, log) == 11 and lots.send_lots(rows, store(folder, set()), log) == (0, 300)


def test_a_lot_that_answers_late(spark, tmp_path):
    attempts = {"n": 0}

    def send(rows):
        attempts["n"] += 1
        if attempts["n"] < 3:
            raise TimeoutError("late")

    assert lots._attempted(send, [{"id": 1}], (0, 0)) == (3, None)
    assert lots.last_durable(spark, str(tmp_path / "none")) == -1

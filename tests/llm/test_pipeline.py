"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    draw = random.Random(6)
    prose = lambda n: " ".join(f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('lmnrst')}{draw.choice('aeiou')}{draw.randint(0, 99)}" for _ in range(n))
    rows = {i: prose(120) for i in range(400)}
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)]
    for i in range(0, 320, 5):
        rows[i] += " awfulword"
    rows[321] = rows[322] = rows[320 + 3]
    shared_passage = prose(60)
    for i in (331, 332, 333):
        rows[i] = prose(100) + " " + shared_passage + " " + prose(100)
    rows[341] += " write to jane.doe@mail.example.com today"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
            seen[name] = {r.doc_id: r.text for r in at.collect()}
    assert {i for i in rows if i not in seen["toxicity"]} == set(range(0, 320, 5))
    assert {321, 322, 323} & {*seen["near_dedup"]} == {321} and len(seen["near_dedup"]) == len(seen["toxicity"]) - 2
    texts = seen["substring_dedup"]
    assert shared_passage in texts[331] and shared_passage not in texts[332] and shared_passage not in texts[333]
    assert texts[340 + 2] == rows[342]
    assert seen["personal_data"][341].endswith("write to [EMAIL] today")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset", "ids").collect()), key=str) == sorted(map(tuple, at.drop("sequence_id", "offset", "ids").collect()), key=str)
    assert at.agg(F.sum("length")).first()[0] == at.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def whole(spark, folder, rows, labels=(), extra=()):
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(c) for c in extra})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_empty_tables(spark, tmp_path):
    """No documents: no pieces. No labels: nothing is toxic, the other stages do their work."""
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert whole(spark, tmp_path / "a", [], [(1, 1, 0)]).collect() == []
    rows = [(i, f"w{i} " * 40, "en", "s", 0) for i in range(5)]
    out = whole(spark, tmp_path / "b", rows)
    assert {r.doc_id for r in out.collect()} == set(range(5))


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text, columns under names that the stages use inside."""
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, "one two three four five six", None, None, None), (1, "one two three four five six", None, None, None), (2, None, "en", "s", 3), (3, "", "en", "s", 0), (None, "no id here at all", "en", "s", 1), (4, long, "en", "s", 1), (5, "  \n\t ", "en", "s", 1)]
    labels = [(1, None, None), (2, 1, 0), (2, 0, 1), (None, 1, 1), (99, 1, 1)]
    out = whole(spark, tmp_path, rows, labels, ("label", "fp", "node", "root", "tie", "key", "k", "row", "unknown", "size", "ids", "start", "length", "bucket", "kind")).collect()
    ids = {r.doc_id for r in out}
    # Of documents without words the first stays, of repeated rows one.
    assert ids == {1, 2, None, 4}
    assert sum(r.length for r in out if r.doc_id == 1) == next(r.doc_tokens for r in out if r.doc_id == 1)
    assert sum(r.length for r in out if r.doc_id == 4) > 30_000

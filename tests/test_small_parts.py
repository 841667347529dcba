"""Parts that no registered query shows alone: evaluation sets, feedback, reports, ranks of sources, embeddings, reranking in batches."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.functions.text import clean_rubric, clean_title, partition_label, self_numbered, sigmoid
from lexlake.operators import bootstrap as bs
from lexlake.operators import embedding, identity, reports, reranking
from lexlake.operators.ingestion import set_status, snapshot_diff
from lexlake.sources import files, tables


def test_evaluation_set(spark):
    df = spark.createDataFrame([("a", "lay"), ("b", "trap")], "q string, kind string")
    assert files.evaluation_set(df).count() == 2
    for kind in ("other", None):
        with pytest.raises(Exception, match="unknown kind"):
            files.evaluation_set(spark.createDataFrame([("a", kind)], df.schema)).collect()


def test_feedback_is_appended(spark, tmp_path):
    path = str(tmp_path / "feedback")
    for k in range(2):
        tables.append_feedback(spark.createDataFrame([(k, "no", None, None), (k + 10, "yes", '["x"]', '{"k": 1}')], "id long, note string, citations string, config string"), path)
    got = {r.id: (r.note, r.citations, r.config) for r in spark.read.parquet(path).collect()}
    assert got == {0: ("no", "[]", "{}"), 1: ("no", "[]", "{}"), 10: ("yes", '["x"]', '{"k": 1}'), 11: ("yes", '["x"]', '{"k": 1}')}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, ["x", "y|z"]), ("a", None, None)], "name string, n long, some array<string>")
    path = reports.write_json_report(df, str(tmp_path), "census", "full", "20240101-000000")
    assert path.endswith("/census-full-20240101-000000")
    lines = [json.loads(x) for f in Path(path).glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["name"]) == [{"name": "a"}, {"name": "b", "n": 2, "some": ["x", "y|z"]}]
    assert reports.write_json_report(df, str(tmp_path), "census", "", "1").endswith("/census-1")
    assert reports.markdown_table(df, [F.asc("name")]) == "| name | n | some |\n| --- | --- | --- |\n| a |  |  |\n| b | 2 | `x`; `y\\|z` |\n"


def test_ranks_and_numbers(spark):
    df = spark.createDataFrame([("header", 0.0), ("urn", 2.0), ("filename", -2.0)], "s string, x double")
    got = [(r.a, round(r.b, 9)) for r in df.select(identity.source_rank(F.col("s")).alias("a"), sigmoid(F.col("x")).alias("b")).collect()]
    assert got == [(0, 0.5), (1, round(1 / (1 + math.exp(-2)), 9)), (2, round(1 / (1 + math.exp(2)), 9))]
    head = bs.head_frame(spark, "abc", "2024-05-01T10:00:00Z").first()
    assert head.commit == "abc" and head.committed_at.year == 2024


def test_the_last_change_of_a_status_counts(spark):
    acts = spark.createDataFrame([("x", "vigente", "1")], "key string, status string, sha string")
    changes = spark.createDataFrame([("x", "decaduto", "2", 1), ("x", "abrogato", None, 2)], "key string, status string, sha string, at long")
    after, met = set_status(acts, changes, "at")
    assert [tuple(r) for r in after.collect()] == [("x", "abrogato", "1")] and met.first().n_rows == 1


def test_embeddings_row_by_row(spark):
    texts = ["uno due", None, "", "due uno", "x " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    got = {r.id: r.embedding for r in embedding.embed(df, "t").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], embedding.hashed_embedding([t or ""])[0])
    assert got[0] == got[3] and all(len(v) == 64 for v in got.values())


def test_titles_rubrics_labels(spark):
    rows = [("Legge (18G00011), di prova (Raccolta 2018) (vera)", "[Legge](http://x) (Articolo 3, comma 1)", "CAPO II - CAPO II Premi", "1-bis", "(( 1-BIS ) testo"), ("(042U0262)", "(Art. 4)", "CAPO II CAPO III", "1", "10. testo")]
    df = spark.createDataFrame(rows, "a string, b string, c string, n string, t string")
    got = [tuple(r) for r in df.select(clean_title(F.col("a")), clean_rubric(F.col("b")), partition_label(F.col("c")), self_numbered(F.col("n"), F.col("t"))).collect()]
    assert got == [("Legge, di prova (vera)", "Legge", "CAPO II Premi", True), (None, None, "CAPO II CAPO III", False)]


def test_pairs_in_batches():
    for lengths, most, budget in (([5, 1, 9, 1, 1], 2, 100), ([50, 1, 60, 2], 9, 20), ([], 3, 3), ([7] * 10, 4, 21)):
        got = [b.tolist() for b in reranking.pair_batches(np.array(lengths, np.int64), most, budget)]
        assert sorted(k for b in got for k in b) == list(range(len(lengths)))
        assert all(len(b) <= most and (len(b) == 1 or len(b) * max(lengths[k] for k in b) <= budget) for b in got)
        flat = [lengths[k] for b in got for k in b]
        assert flat == sorted(flat)


def test_reranking_equals_one_pair_at_a_time(spark):
    rows = [(q, i, (i * 7 + q) % 20 + 1, f"query {q}" * (q + 1), f"text {i} " * (i % 13) if i % 5 else None) for q in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank long, q string, t string").repartition(3)
    seen = lambda q, t: float(len(q) * 3 % 7 + len(t) % 4)

    def scorer(pairs):
        assert len(pairs) <= 4
        return [seen(q, t) for q, t in pairs]

    got = {(r.query_id, r.rank): (r.id, r.score) for r in reranking.rerank_pairs(df, "q", "t", scorer, 5, most=4, budget=200).collect()}
    for q in range(6):
        mine = sorted(((-seen(r[3], r[4] or ""), r[2], r[1]) for r in rows if r[0] == q))[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, _, i in mine]


def test_moves_among_many_equal_files(spark):
    """A thousand empty files change their folder: the k-th that vanishes goes with the k-th that comes, in ranges of paths."""
    old = [(f"a/{k:04d}", "e") for k in range(1000)] + [("x", "1"), ("y", "2"), ("z", "3")]
    new = [(f"b/{k:04d}", "e") for k in range(1005)] + [("x", "1"), ("y", "9")]
    got = snapshot_diff(*(spark.createDataFrame(r, "path string, sha string") for r in (old, new))).collect()
    moves = {r.old_path: r.path for r in got if r.status == "move"}
    assert moves == {f"a/{k:04d}": f"b/{k:04d}" for k in range(1000)}
    assert sorted((r.status, r.path) for r in got if r.status != "move") == [("delete", "z"), *(("upsert", f"b/{k}") for k in range(1000, 1005)), ("upsert", "y")]

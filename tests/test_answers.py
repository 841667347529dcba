"""Composite retrieval on small conversations, by hand."""

import pytest

from lexlake.operators import pipeline as pl
from lexlake.operators.understanding import transcripts, understand

TURNS = [
    (1, 0, "user", "che dice il d.lgs. 81/2008?"), (1, 1, "assistant", "vedi [[dlgs-81-2008|art.2]]"), (1, 2, "user", "e l'articolo 1?"),
    (2, 0, "user", "art. 2 della legge 241/1990 e la legge 9/1999"), (3, 0, "assistant", "ciao"), (4, 0, "user", "domanda libera"),
]
CHUNKS = [
    ("a1", "dlgs-81-2008", "1", 0, 1, "testo di cui al comma 2 e all'art. 2 della legge 241/1990, all'art. 2, comma 3, della legge 241/1990; vedi il codice civile"),
    ("a2", "dlgs-81-2008", "2", 0, 2, "altro"), ("l2", "legge-241-1990", "2", 0, 2, "si veda l'art. 1 del d.lgs. 81/2008"), ("l1", "legge-241-1990", "1", 0, 1, "uno"),
    ("c1", "codice-civile", "1", 0, 1, "primo"), ("c2", "codice-civile", "2", 0, 2, "secondo " * 50),
]


def frames(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, act_ref string, article string, split_no int, legal_no int, text string")
    hybrid = spark.createDataFrame([(1, "a2", 1), (2, "l2", 1), (2, "a2", 2), (4, "l1", 1)], "query_id long, id string, rank int")
    return turns, chunks, hybrid


def test_answer_context(spark):
    turns, chunks, hybrid = frames(spark)
    acts = chunks.select("act_ref").distinct()
    got = {}
    for r in pl.answer_context(turns, chunks, hybrid, 5, 40, acts).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.id, r.tier))
    # 1: article 1 is bound to the act of the marker; it cites article 2 of the law (twice) before the code, whose second
    # chunk passes the budget. 2: the law's article, then a hybrid hit; its citation is followed, law 9 of 1999 isn't held.
    assert got == {1: [("a1", 0), ("a2", 1), ("l2", 3), ("c1", 3)], 2: [("l2", 0), ("a2", 1), ("a1", 3)], 4: [("l1", 1)]}


def test_references_without_act(spark):
    refs = spark.createDataFrame([(1, None, "5"), (1, "x", "1"), (2, None, "5"), (2, "x", None), (2, "y", None), (3, None, "5"), (4, None, None), (5, None, "7")], "query_id long, act_ref string, article string")
    context = spark.createDataFrame([(1, "z"), (3, "z"), (4, "z"), (5, "z"), (5, "w")], "query_id long, act_ref string")
    got = sorted(map(tuple, pl.bind_unbound(refs, context).collect()), key=str)
    assert got == [(1, "x", "1"), (1, "x", "5"), (2, "x", None), (2, "y", None), (3, "z", "5")]


def test_unknown_acts_pass_without_a_table(spark):
    refs = spark.createDataFrame([("x", True), ("y", True), ("code", False)], "act_ref string, computed boolean")
    assert pl.existing(refs, None).count() == 3
    assert sorted(r.act_ref for r in pl.existing(refs, spark.createDataFrame([("x",)], "act_ref string")).collect()) == ["code", "x"]


def test_understanding(spark):
    turns, _, _ = frames(spark)
    got = {r.conv_id: (r.history, r.current) for r in transcripts(turns).collect()}
    assert got[1] == ("user: che dice il d.lgs. 81/2008?\nassistant: vedi [[dlgs-81-2008|art.2]]", "e l'articolo 1?") and got[4] == ("", "domanda libera") and 3 not in got

    def model(history, current):
        if "libera" in current:
            raise RuntimeError("no answer")
        return f"{len(history)}:{current}" if history else ""

    told = {r.conv_id: (r.query, r.understood) for r in understand(turns, model).collect()}
    assert told[4] == ("domanda libera", False) and told[2][1] is False and told[1] == (f"{len(got[1][0])}:e l'articolo 1?", True)
    assert {r.understood for r in understand(turns).collect()} == {False}
    with pytest.raises(KeyError):
        _ = got[3]

"""Periodic runs, vector codes and language against brute force, held-out accuracy, and the cases their docstrings define."""

import hashlib
import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm import language, periodic, queries, vector_codes

DATA = "/root/testdata/sf0.001"
EDGE = [(1, "a b c"), (1, "a b c"), (2, ""), (3, None), (None, "null id"), (None, None), (7, "word " * 30_000), (8, "Ünï " * 40), (9, "x y " * 9 + "end"), (10, "x y " * 9 + "end"), (11, " \t\n"), (12, "½ ² 123 !?")]
CLASHING = ("word", "words", "runs", "start", "v", "x", "code", "label", "lang", "score", "error", "lang_pred", "bucket", "unlabelled", "of")


def edge(spark, rows=EDGE):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def brute_runs(x, least=6, power=4):
    """Every period from the smallest on, every stretch."""
    n, out = len(x), {}
    for p in range(1, n // power + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(least, power * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n_, p) for (s, n_), p in out.items()), key=lambda r: (r[0], r[2]))


def words_with_repeats(draw, n):
    kinds, x = draw.randint(1, 4), []
    while len(x) < n:
        how = draw.randint(0, 2)
        if how == 0:
            x += [draw.randint(0, kinds) for _ in range(draw.randint(1, 10))]
        elif how == 1:
            x += [draw.randint(0, kinds) for _ in range(draw.randint(1, 9))] * draw.randint(1, 12)
        else:
            x += [draw.randint(100, 10**6)] * draw.randint(1, 8)
    return x[:n]


@pytest.mark.parametrize(("least", "power"), [(6, 4), (1, 2), (9, 3), (4, 2)])
def test_runs_equal_brute_force(least, power):
    draw = random.Random(least)
    found = 0
    for _ in range(700):
        x = words_with_repeats(draw, draw.choice([draw.randint(0, 30), draw.randint(30, 400)]))
        want = brute_runs(x, least, power)
        assert periodic.runs_of(np.array(x, np.int64), least, power) == want
        found += len(want)
    assert found > 500


def test_words_outside_segments_are_in_no_run():
    draw = random.Random(2)
    k = periodic.least_overlap()
    assert k == 5
    for _ in range(300):
        x = words_with_repeats(draw, draw.randint(0, 200))
        inside = {i for a, b in periodic.segments(np.array(x, np.int64), k) for i in range(a, b)}
        grams = [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
        assert inside == {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(k)}
        assert all(i in inside for s, n, _ in brute_runs(x) for i in range(s, s + n))


def test_runs_take_n_log_n():
    """One word, and one long period, 100,000 words: by shifts this would be 2.5 billion comparisons."""
    began = time.time()
    assert periodic.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert periodic.runs_of(np.arange(100_000) % 20_000) == [(0, 100_000, 20_000)]
    assert time.time() - began < 20


def brute_digest(i, text):
    w = (text or "").encode().split()
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_run_digest(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 9_000]
    got = periodic.run_digest(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_digest(*r) for r in some)
    assert sum(r.n_runs > 0 for r in got) > 10
    got = queries.op11_main_lorentz_runs(spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.count() == docs.count()


def test_run_edges(spark):
    out = periodic.periodic_runs(edge(spark)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in EDGE), key=str)
    by = {r.doc_id: r for r in out}
    assert [tuple(r) for r in by[7].runs] == [(0, 30_000, 1)] and by[7].collapsed == "word"
    assert by[9].collapsed == "x y end" == by[10].collapsed and by[1].collapsed == "a b c"
    assert by[3].n_words == by[2].n_words == by[11].n_words == 0 and by[3].collapsed == "" and by[11].collapsed == " \t\n"
    out = periodic.run_digest(edge(spark)).collect()
    none = next(r for r in out if r.doc_id == 2)
    assert none[1:6] == (0, None, None, None, None) and none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    for f in (periodic.periodic_runs, periodic.run_digest):
        assert f(edge(spark, [])).collect() == []


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds in Python's whole numbers, every distance computed."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    step = -(-len(kept[0][1]) // parts)
    kept = [(i, v + [0] * (step * parts - len(v))) for i, v in kept]
    books = [[v[p * step : (p + 1) * step] for _, v in sorted(kept)[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * step : (p + 1) * step], c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = {}
            for _, v in kept:
                of.setdefault(nearest(p, v)[1], []).append(v[p * step : (p + 1) * step])
            new.append([[sum(x) // len(of[k]) for x in zip(*of[k], strict=True)] if k in of else c for k, c in enumerate(books[p])])
        books = new
    return {i: (bytes(nearest(p, v)[1] for p in range(parts)), sum(nearest(p, v)[0] for p in range(parts))) for i, v in kept}, books


@pytest.mark.parametrize(("n", "width", "parts", "rounds"), [(300, 64, 16, 2), (40, 16, 16, 2), (200, 10, 4, 5), (120, 3, 2, 1)])
def test_codes_equal_brute_force(spark, n, width, parts, rounds):
    draw = np.random.default_rng(n)
    # Coarse values, so that many distances tie and entries coincide.
    rows = [(i, (draw.integers(-6, 7, width) / 256 + draw.choice([0, 0.001])).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    coded, books = vector_codes.fit_and_encode(df, label_col=None, parts=parts, rounds=rounds)
    want, entries = brute_codes(rows, parts, rounds=rounds)
    assert {r.vec_id: (bytes(r.code), r.error) for r in coded.collect()} == want
    assert books.entries.tolist() == entries


def test_elkan_bounds_hold_and_prune():
    draw = np.random.default_rng(0)
    x = np.floor(draw.normal(0, 30, (5000, 4))).astype(np.int64)
    entries = x[:64].copy()
    bounds, error = vector_codes.first_bounds(x, entries)
    for _ in range(4):
        moved = np.array([x[bounds.code == k].sum(0) // max(1, (bounds.code == k).sum()) for k in range(64)])
        bounds, error, computed = vector_codes.next_bounds(x, bounds, vector_codes.Step.of(moved, entries))
        entries = moved
        every = ((x[:, None] - entries) ** 2).sum(-1)
        assert (bounds.code == every.argmin(1)).all() and (error == every.min(1)).all()
        assert (bounds.lower() <= np.sqrt(every)).all() and (bounds.upper >= np.sqrt(error)).all()
        assert computed < 0.1 * every.size


def test_code_digest_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(queries.SQL["op12_elkan_vector_codes"])
    got = queries.op12_elkan_vector_codes(spark, DATA)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_code_edges(spark):
    good = [[0.1 * k, -0.2, 0.3, 0.0] for k in range(5)]
    rows = [(3, good[0], 1), (1, good[1], None), (1, good[1], None), (2, None, 1), (4, [0.1, None, 0.2, 0.3], 1), (5, [0.1, float("nan"), 0.2, 0.3], 2), (6, [float("inf")] * 4, 2), (None, good[2], 1), (8, [0.1], 1), (9, [1e30, -1e30, 0.0, 0.0], 3), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(c) for c in ("v", "x", "code", "error", "upper", "steps", "unlabelled", "of")})
    out = vector_codes.code_digest(df, parts=2).collect()
    assert sorted((r.vec_id for r in out), key=str) == sorted([3, 1, 1, None, 9], key=str)
    assert len({r.code for r in out if r.vec_id == 1}) == 1 and all(len(r.code) == 4 for r in out)
    by = {}
    for r, label in ((r, {3: 1, None: 1, 1: None, 9: 3}[r.vec_id]) for r in out):
        by.setdefault(label, []).append(r)
    assert all(r.label_error == sum(x.error for x in same) for same in by.values() for r in same)
    for empty in (df.limit(0), df.where("vec_id = 2")):
        assert vector_codes.code_digest(empty).collect() == []
    coded, books = vector_codes.fit_and_encode(spark.createDataFrame([(k, v) for k, v in enumerate(good)], "vec_id long, embedding array<double>"), label_col=None, parts=2)
    back = {r.vec_id: r.decoded for r in vector_codes.decode(coded, books).collect()}
    assert all(abs(a - b) <= 1 / 256 for k, v in enumerate(good) for a, b in zip(v, back[k], strict=True))
    with pytest.raises(ValueError):
        vector_codes.fit_and_encode(df, entries=300)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op13_subword_language(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    got = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_learns_from_its_rows_alone(spark):
    """Languages of held-out documents, and of documents without text, play no part."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "aba bab abba " * 5 if i % 2 else "xyz zyx yzzy " * 5, ("odd" if i % 2 else "even") if i not in held else "wrong") for i in range(400)]
    model = language.fit_language(spark.createDataFrame([*rows, (500, None, "none")], "doc_id long, text string, lang string"))
    assert model.languages == ["even", "odd"]
    out = language.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == ("odd" if r.doc_id % 2 else "even") and r.score > 0.9 and r.accepted for r in out)


def test_language_sums_equal_counts():
    """What a worker adds up word by word is the average that the model learned from, long words and any order of learning included."""
    draw = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b"], draw.random((language.BUCKETS, language.WIDTH)).astype("f4"), draw.random((language.WIDTH, 2)).astype("f4"), np.zeros(2, "f4"))
    texts = ["Ein Haus, ein Garten", "z" * 200_000 + " kurz", "日本語 の テスト", "a b " * 300, "ünïcode wörter " * 20]
    words = [language.words_of(t) for t in texts]
    sums = language._Sums(model)
    for w in words:
        sums.learn([w])
    again = language._Sums(model)
    again.learn(words[::-1])
    for w in words:
        bucket, part = language.counted(w)
        assert np.allclose(sums.average(w), part @ model.embeddings[bucket], atol=1e-3)
        assert (sums.average(w) == again.average(w)).all()


def test_language_calibration():
    """Rows of which a fifth are mislabelled: the softened probabilities say so, and the level is where 98 of 100 are right."""
    draw = np.random.default_rng(3)
    model = language.LanguageModel(["a", "b"], np.zeros((language.BUCKETS, language.WIDTH), "f4"), np.zeros((language.WIDTH, 2), "f4"), np.zeros(2, "f4"))
    model.embeddings[:2, 0] = 3, -3
    model.weights[0] = 1, -1
    rows = [(int(k % 2) ^ int(draw.random() < 0.2), np.array([k % 2]), np.ones(1, "f4")) for k in range(2000)]
    language.calibrate(model, rows)
    p = model.probabilities(np.array([[3.0] + [0.0] * (language.WIDTH - 1)]))
    assert abs(p.max() - 0.8) < 0.05 and model.least == 1.0
    sure = [(int(k % 2), np.array([k % 2]), np.ones(1, "f4")) for k in range(200)]
    language.calibrate(model, sure)
    assert model.probabilities(np.array([[3.0] + [0.0] * (language.WIDTH - 1)])).max() >= model.least


def test_language_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language(docs)
    out = language.predict_language(edge(spark), model).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in EDGE), key=str)
    assert all((r.lang_pred == "und" and r.score == 0 and not r.accepted) == (r.doc_id in (2, 3, 11, 12)) for r in out if r.doc_id is not None)
    assert len({tuple(r) for r in out if r.doc_id == 1}) == 1
    assert {r.score for r in out if r.doc_id == 9} == {r.score for r in out if r.doc_id == 10}
    assert language.predict_language(edge(spark, []), model).collect() == []
    empty = language.fit_language(docs.limit(0))
    assert empty.languages == [] and {r.lang_pred for r in language.predict_language(edge(spark), empty).collect()} == {"und"}

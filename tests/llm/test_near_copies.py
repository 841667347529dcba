"""The pipeline's near-copy stage against exact similarities on both sides of 0.8."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm import near_copies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(draw, n):
    return [f"{draw.choice('bcdfg')}{int(draw.paretovariate(0.6)) % 5000}" for _ in range(n)]


def edited(draw, low, high):
    """A text and one with single words exchanged here and there, of a similarity from low to high."""
    while True:
        words = prose(draw, draw.randint(100, 400))
        other = list(words)
        for k in draw.sample(range(len(words)), draw.randint(1, len(words) // 20)):
            other[k] = f"x{draw.randint(0, 10**6)}"
        a, b = " ".join(words), " ".join(other)
        if low <= similarity(a, b) < high:
            return a, b


def least_reachable(texts):
    """For each text the first that it reaches over pairs of 0.8 or more, by comparing all pairs."""
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if root(a) != root(b) and similarity(texts[a], texts[b]) >= 0.8:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(texts))]


def kept(spark, texts, parts=3):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    return sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect())


def test_all_near_copies_are_found(spark):
    draw = random.Random(5)
    texts = [t for _ in range(60) for t in edited(draw, 0.8, 0.85)]
    assert kept(spark, texts) == [*range(0, 120, 2)]


def test_texts_below_the_limit_stay(spark):
    """Pairs of 0.7 to 0.79, near by their sketches and not by their shingles."""
    draw = random.Random(8)
    texts = [t for _ in range(60) for t in edited(draw, 0.7, 0.79)]
    assert kept(spark, texts) == [*range(120)]


def test_families_by_brute_force(spark):
    """Chains and families around a template on both sides of the limit, where first candidates are often refuted."""
    draw = random.Random(12)
    texts = []
    for _ in range(6):
        template = prose(draw, draw.randint(40, 160))
        chain = list(template)
        for _ in range(22):
            words = list(chain if draw.random() < 0.5 else template)
            for k in draw.sample(range(len(words)), draw.randint(1, 3)):
                words[k] = f"y{draw.randint(0, 10**6)}"
            chain = words
            texts.append(" ".join(words))
    draw.shuffle(texts)
    assert kept(spark, texts) == sorted({*least_reachable(texts)})


def test_a_large_group_is_one(spark):
    """Copies of one text with one word exchanged each, more than a batch of rows holds."""
    draw = random.Random(3)
    words = prose(draw, 120)
    texts = []
    for k in range(1500):
        words[draw.randrange(120)], was = f"z{k}", list(words)
        texts.append(" ".join(words))
        words = was
    assert kept(spark, texts) == [0]


def test_settled_nodes_are_not_read_again(spark, monkeypatch):
    """Of a template's variants on both sides of the limit, rounds read again only nodes with a new candidate, beside the
    largest class of their key; twice the variants make no more than about twice the rows."""
    asked, plain = [], near_copies.further_links

    def counted(rows):
        asked[-1].append((rows.where("not big").count(), rows.count()))
        return plain(rows)

    monkeypatch.setattr(near_copies, "further_links", counted)
    draw = random.Random(21)
    template, texts = prose(draw, 120), []
    for _ in range(240):
        words = list(template)
        for i in draw.sample(range(120), draw.choice([1, 1, 2, 3, 4])):
            words[i] = f"y{draw.randint(0, 10**6)}"
        texts.append(" ".join(words))
    for n in (120, 240):
        asked.append([])
        assert kept(spark, texts[:n]) == sorted({*least_reachable(texts[:n])})
    for rounds in asked:
        assert len(rounds) > 1
        assert sum(few for few, _ in rounds[1:]) < rounds[0][0] / 4
    assert sum(n for _, n in asked[1]) < 3 * sum(n for _, n in asked[0])


def test_keys_of_bands_meet():
    draw = np.random.default_rng(3)
    missed = 0
    for n in [*range(5, 120), 500, 2000] * 3:
        common = -(-8 * n // 9)
        h = np.unique(draw.integers(0, 1 << 63, 2 * n - common).astype(np.uint64))
        draw.shuffle(h)
        a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n:]]))
        assert near_copies.near(common, len(a), len(b))
        missed += not {*near_copies.band_keys(a).tolist()} & {*near_copies.band_keys(b).tolist()}
        c = [np.frombuffer(near_copies.counts(x), np.uint8) for x in (a, b)]
        assert near_copies.may_be_near(len(a), c[0], np.array([len(b)]), c[1][None]).all()
    assert missed == 0


EDGE = [(1, "a b c"), (1, "a b c"), (1, "other text with an id that repeats"), (2, ""), (3, None), (None, "a b c"), (None, None), (7, "word " * 30_000), (8, "w" * 200_000), (9, "a B c")]
INNER = ("unknown", "doc_id_", "tie", "_id", "_tie", "_unknown", "_row", "row", "k", "first", "node", "root", "keys")


@pytest.mark.parametrize("rows", [EDGE, []])
def test_odd_rows_and_clashing_names(spark, rows):
    """Columns named as inner ones keep their values."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in INNER})
    out = near_copies.drop_near_copies(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    got = out.collect()
    assert sorted((r.doc_id, r.text[:9]) for r in got) == ([(1, "a b c"), (1, "other tex"), (2, ""), (7, "word word"), (8, "w" * 9)] if rows else [])
    assert all(r[c] == f"{c} of {r.doc_id}" for r in got for c in INNER)

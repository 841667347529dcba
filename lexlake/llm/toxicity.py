"""Toxicity: cumulative-link ordinal regression from sparse words to graded severity."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import batches, pairs, release_memory, stored, texts

SAMPLE_DOCS = 4096
LEAST_DOCS = 4
MOST_FEATURES = 4096
COMMON = 0.03
SPARSE = 5e-4
#: How strongly cuts are held to the grades' shares, for grades that no document has.
HELD = 1e-3
#: No two cuts lie closer.
GAP = 1e-3
GRADES = 3
STEMS = (3, 4, 5, 6)
_WORD = re.compile(r"\w+")


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    """The word, and its stems of some lengths: inflected and compound forms share those."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def features(text: str | None) -> Counter:
    """How often each feature occurs."""
    out: Counter = Counter()
    for w, c in words(text).items():
        for f in word_features(w):
            out[f] += c
    return out


def value(count: int) -> float:
    """Sublinear in a word's count."""
    return 1.0 + math.log(count)


@dataclass
class OrdinalModel:
    """P(grade >= k) = 1 / (1 + exp(cut[k-1] - sum of word weights)): the weights are shared by all ordered cuts."""

    weights: dict[str, float]
    cuts: list[float]

    def above(self, counts: Counter) -> list[float]:
        """Of a text's words, for each cut."""
        w, found = self.weights, Counter()
        for x, c in counts.items():
            if x in w:
                found[x] += c
            for k in STEMS:
                if len(x) > k and (f := x[:k] + "*") in w:
                    found[f] += c
        s = sum(w[f] * value(c) for f, c in found.items())
        return [1 / (1 + math.exp(min(700, max(-700, b - s)))) for b in self.cuts]

    def severity(self, counts: Counter) -> float:
        """Expected grade."""
        return sum(self.above(counts))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def loss(s: np.ndarray, cuts: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades y at scores s, and its slopes by s (of each row) and by the cuts.

    P(grade = k) is the difference of two logistics: F(cuts[k] - s) - F(cuts[k-1] - s), the outer ones 1 and 0.
    `held` are the cuts that a weak penalty draws to.
    """
    n = len(s)
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    low, high = _logistic(edge[y] - s), _logistic(edge[y + 1] - s)
    p = np.maximum(high - low, 1e-12)
    by_cut = HELD * (cuts - held)
    np.add.at(by_cut, y[y < len(cuts)], -(high * (1 - high) / p)[y < len(cuts)] / n)
    np.add.at(by_cut, y[y > 0] - 1, (low * (1 - low) / p)[y > 0] / n)
    return -float(np.log(p).mean()) + HELD / 2 * float(np.square(cuts - held).sum()), (1 - low - high) / n, by_cut


def fit(row: np.ndarray, column: np.ndarray, x: np.ndarray, y: np.ndarray, d: int, grades: int = GRADES, sparse: float = SPARSE, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights of d features, cuts): the least of loss() plus `sparse` times the sum of absolute weights.

    The features are entries (row, column, x) of a sparse matrix; y are grades from 0 to grades - 1. The penalised
    likelihood is convex; accelerated proximal gradient steps, each as long as the loss allows, lead to its least. Most
    features get no weight at all. Without two different grades nothing is learned: no weights, cuts from shares.
    """
    n = len(y)
    start = np.array([math.log(((y < k).sum() + 1) / ((y >= k).sum() + 1)) for k in range(1, grades)])
    start = np.maximum.accumulate(start + GAP * np.arange(grades - 1))
    if len(np.unique(y)) < 2 or not d:
        return np.zeros(d), start
    # Frequent features scaled down to the spread of one in COMMON of the documents; rare ones have to earn their weight.
    scale = 1 / np.sqrt(np.maximum(np.bincount(column, x * x, d) / n, COMMON))
    v = x * scale[column]

    def slopes(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value_, by_s, by_b = loss(np.bincount(row, v * w[column], n), b, y, start)
        return value_, np.bincount(column, v * by_s[row], d), by_b

    w, b = np.zeros(d), start.copy()
    zw, zb, t, curve = w, b, 1.0, 1.0
    for _ in range(steps):
        at, gw, gb = slopes(zw, zb)
        while True:
            nw = zw - gw / curve
            nw = np.sign(nw) * np.maximum(np.abs(nw) - sparse / curve, 0)
            nb = np.maximum.accumulate(zb - gb / curve - GAP * np.arange(grades - 1)) + GAP * np.arange(grades - 1)
            dw, db = nw - zw, nb - zb
            if slopes(nw, nb)[0] <= at + gw @ dw + gb @ db + curve / 2 * (dw @ dw + db @ db) + 1e-12:
                break
            curve *= 2
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if (nw - w) @ (zw - nw) + (nb - b) @ (zb - nb) > 0:  # past the least: no momentum for a step
            nt = 1.0
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t, curve = nw, nb, nt, curve / 1.2
    return w * scale, b


_COUNTS = pa.schema([("feature", pa.string()), ("k", pa.int64()), ("k1", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("columns", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic, 2 toxic and of low quality; a null or absent quality counts as good, a null
    toxic stays null."""
    quality = F.coalesce(F.col("quality").cast("int"), F.lit(1)) if "quality" in labels.columns else F.lit(1)
    toxic = F.col("toxic").cast("int")
    return labels.select("doc_id", F.when(toxic == 1, F.when(quality == 0, 2).otherwise(1)).when(toxic == 0, 0).alias("grade"))


def fit_toxicity(docs: DataFrame, grades: DataFrame, sample_docs: int = SAMPLE_DOCS, sparse: float = SPARSE) -> OrdinalModel:
    """From at most sample_docs documents of (doc_id, grade), grades from 0 to GRADES - 1.

    Tasks count the features; of those that LEAST_DOCS documents or more have, the MOST_FEATURES that differ most between
    grade 0 and the others are fitted. Only their counts, for the sampled documents, come to the driver. Ids without
    grade or text are left out, of several grades of an id the smallest counts. Without two grades, or without words,
    nothing has weight.
    """

    def count(got):
        """How many documents of the task have each feature, and how many of those have a grade above 0."""
        every: Counter = Counter()
        above: Counter = Counter()
        for batch in got:
            for g, t in pairs(batch, "label", "text"):
                found = {f for w in words(t) for f in word_features(w)}
                every.update(found)
                if g:
                    above.update(found)
        yield from batches(((f, k, above[f]) for f, k in every.items()), _COUNTS)
        release_memory()

    sample = stored(labelled_sample(docs, grades.where(F.col("grade").between(0, GRADES - 1)), "grade", sample_docs))
    every = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, toxic = sum(every.values()), sum(c for g, c in every.items() if g)
    share = toxic / n if n else 0.0
    k, k1 = F.col("k"), F.col("k1")
    differ = F.abs(k1 - k * share) / F.sqrt(F.greatest(k * (share * (1 - share)) * (1 - k / (n + 1)), F.lit(1e-9)))
    counted = sample.select("label", "text").mapInArrow(count, "feature string, k long, k1 long").groupBy("feature").agg(F.sum("k").alias("k"), F.sum("k1").alias("k1"))
    some = counted.where(k >= min(LEAST_DOCS, 1 + n // 100)).orderBy(differ.desc(), "feature").limit(MOST_FEATURES)
    names = sorted(r.feature for r in some.select("feature").collect())
    number = {f: j for j, f in enumerate(names)}

    def chosen(got):
        for batch in got:
            def rows(batch=batch):
                for i, g, t in pairs(batch, "doc_id", "label", "text"):
                    found = sorted((number[f], c) for f, c in features(t).items() if f in number)
                    yield i, g, [j for j, _ in found], [c for _, c in found]

            yield from batches(rows(), _FOUND, 512)

    # As arrays of numbers, not as rows of objects: sample_docs documents with MOST_FEATURES features each at most.
    got = sample.mapInArrow(chosen, "doc_id long, label int, columns array<int>, counts array<int>").toArrow().sort_by("doc_id").combine_chunks()
    sizes = np.array(got["columns"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), np.int64) if len(got) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column, times = (np.array(got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64) if len(got) else np.zeros(0, np.int64) for c in ("columns", "counts"))
    x, y = 1.0 + np.log(np.maximum(times, 1)), got["label"].to_numpy().astype(np.int64)
    w, b = fit(row, column, x, y, len(names), GRADES, sparse)
    release_memory()
    if not w.any():
        # Nothing tells documents apart: none is called toxic, whatever the sample's shares.
        b = np.maximum(b, 1.0 + np.arange(len(b)))
    return OrdinalModel({f: float(w[j]) for j, f in enumerate(names) if w[j]}, [float(c) for c in b])


SCORED = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.int32())])


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, severity (expected grade, 0 to 2), p_toxic (of grade 1 or more), grade, toxic.

    grade is the number of cuts that the document is likelier above than not, ties counting as above; toxic is 1 from
    grade 1 on. Null and empty texts have no words: the severity of the cuts alone. Very long texts are read whole. Null
    ids stay null; repeated rows give a row each; an empty table gives no rows; other columns play no part.
    """

    def run(got):
        for batch in got:
            def rows(batch=batch):
                for i, text in pairs(batch, "doc_id", "text"):
                    p = model.above(words(text))
                    yield i, sum(p), p[0], sum(x >= 0.5 for x in p), int(p[0] >= 0.5)

            yield from batches(rows(), SCORED)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic int")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows whose grade is 0, all columns unchanged; null and empty texts stay. Repeated rows go or stay alike, an empty
    table stays empty; other columns may have any name."""
    at = docs.columns.index(text_col)

    def run(got):
        for batch in got:
            keep = [t is None or model.above(words(t))[0] < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

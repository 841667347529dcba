"""Quality: a Bradley-Terry ranking of documents, learned from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import batches, pairs, texts

SAMPLE_DOCS = 20_000
PAIRS = 20_000
CUT = 0.3
_LINES = re.compile("[\n\r]+")
_UPPER, _LOWER, _DIGIT = ([k for k in range(128) if f(chr(k))] for f in (str.isupper, str.islower, str.isdigit))
_SIGNS = "!#$%&*|.,=\"@"


def statistics(text: str | None) -> list[float]:
    """Of a whole text: lengths, letter cases, signs, repetition of words and lines. An empty text has all zeros."""
    text = text or ""
    word = text.split()
    if not word:
        return [0.0] * N_STATISTICS
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, chars = len(word), len(text)
    lines = [x for x in _LINES.split(text) if x.strip()]
    counts = Counter(word)
    top = counts.most_common(3)
    again = sum(map(operator.eq, word, word[1:]))
    pairs_ = Counter(zip(word, word[1:], strict=False)).most_common(1)
    lengths = [len(w) for w in word]
    return [
        1.0, math.log(n), math.log(chars), chars / n, max(lengths) / 100, len(counts) / n, math.sqrt(n) * len(counts) / n,
        top[0][1] / n, sum(c for _, c in top) / n, again / n, pairs_[0][1] / n if pairs_ else 0.0,
        len({*lines}) / len(lines), len(lines) / n, raw[_UPPER].sum() / chars, raw[_LOWER].sum() / chars, raw[_DIGIT].sum() / chars,
        raw[128:].sum() / chars, sum(map(str.isupper, word)) / n, *(raw[ord(c)] / n for c in _SIGNS),
    ]


N_STATISTICS = 18 + len(_SIGNS)


@dataclass
class RankModel:
    """score = logistic((margin - threshold) / spread + log-odds of CUT): margin is the Bradley-Terry score."""

    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Each statistic as steps between its knots: 0 below, 1 above, linear within."""
        low, high = self.knots[:-1], self.knots[1:]
        wide = np.where(high > low, high - low, 1)
        return np.clip((x[:, None, :] - low) / wide, 0, 1).reshape(len(x), -1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.margins(x) - self.threshold) / self.spread + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, n_pairs: int = PAIRS, n_knots: int = 6, decay: float = 1e-3) -> RankModel:
    """Weights by Newton steps on the logistic loss of feature differences of n_pairs (label 1, label 0) pairs.

    The threshold is the quantile of the sample's scores at the share of label 0. Without both labels all scores
    are equal and above the cut.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(np.zeros((2, x.shape[1] if x.ndim == 2 and x.shape[1] else N_STATISTICS)), np.zeros(x.shape[1] if x.ndim == 2 and x.shape[1] else N_STATISTICS), -1.0, 1.0)
    model = RankModel(np.quantile(x, np.linspace(0, 1, n_knots), axis=0), np.zeros(0), 0.0, 1.0)
    f = model.expand(x)
    draw = np.random.default_rng(7)
    d = f[draw.choice(good, n_pairs)] - f[draw.choice(bad, n_pairs)]
    w = np.zeros(f.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # that the worse one would win
        slope = d.T @ p / n_pairs - decay * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n_pairs + decay * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    m = f @ w
    model.threshold = float(np.quantile(m, len(bad) / len(y)))
    model.spread = float(max(1e-6, np.std(m)))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> RankModel:
    """From at most sample_docs labelled documents, of those whose crc32(id) mod 5 isn't 0; the rest is held out.

    Labels that are null or of a null or unknown id don't count, nor do null texts; of several labels of an id the smallest counts. Without rows
    of both labels all scores are equal, and above the cut.
    """

    def run(got):
        for batch in got:
            yield from batches(((y, statistics(t)) for y, t in pairs(batch, "label", "text")), _SAMPLE)

    rows = labelled_sample(docs, labels, "quality", sample_docs, ~held_out("doc_id"))
    got = rows.orderBy("doc_id").select("label", "text").mapInArrow(run, "label int, x array<double>").collect()
    return fit(np.array([r.x for r in got]).reshape(-1, N_STATISTICS), np.array([r.label for r in got]))


_SAMPLE = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(docs: DataFrame, model: RankModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, score (0 to 1), predicted (1 from a score of CUT on).

    Null and empty texts have all statistics 0. A null id stays null and isn't held out; repeated rows give a row each, equal texts the
    same score. Very long texts are read whole; an empty table gives no rows; other columns play no part.
    """

    def run(got):
        for batch in got:
            rows = list(pairs(batch, "doc_id", "text"))
            for k in range(0, len(rows), 1024):
                part = rows[k : k + 1024]
                s = model.scores(np.array([statistics(t) for _, t in part]))
                yield from batches(zip((i for i, _ in part), s.tolist(), strict=True), _SCORES)

    scored = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

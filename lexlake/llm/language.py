"""Language of a text: the average of hashed subword embeddings under a linear softmax, calibrated, with a level below which it is doubtful."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batches, cached, pairs, release_memory, texts

UNKNOWN = "und"
#: Labelled documents read for fitting, at most so many on average, and languages, the most frequent ones.
SAMPLE_DOCS, MOST_LANGUAGES = 4_000, 256
BUCKETS, WIDTH = 1 << 16, 16
SIZES = (1, 2, 3, 4)
#: Characters of the words whose sums a worker keeps, beside those of the texts at hand, and rows of numbers gathered at a time.
CACHED_CHARS, GATHERED = 2_000_000, 1 << 16
#: Longer words are summed alone, in parts.
LONG = 4096
#: Among doubtful and other predictions, the share of right ones that the others must reach on the calibration rows.
PRECISION = 0.98

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if the text has no letter."""
    words = _LETTERS.findall((text or "").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character grams, borders included, and of the words themselves, as (buckets, number of the word)."""
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), length)
    gram = np.zeros(len(code), np.uint64)
    found, owners = [], []
    for n in range(1, max(SIZES) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        inside = owner[:m] == owner[n - 1 :]
        if n in SIZES:
            found.append(gram[inside])
            owners.append(owner[:m][inside])
    if len(code):
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(_mixed(code + np.uint64(1) + (np.arange(len(code), dtype=np.uint64) - np.repeat(np.cumsum(length) - length, length).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(length) - length)
        found.append(whole)
        owners.append(np.arange(len(words)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (_mixed(np.concatenate(found)) >> np.uint64(32)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of its subwords that each holds."""
    bucket, n = np.unique(subwords(words)[0], return_counts=True)
    return bucket, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    """Probabilities are the softmax of (average embedding @ weights + bias) / temperature; below `least` a prediction is doubtful."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, average: np.ndarray) -> np.ndarray:
        return average @ self.weights + self.bias

    def probabilities(self, average: np.ndarray) -> np.ndarray:
        return softmax(self.logits(average) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: A labelled text: its language's number, buckets, shares.
Example = tuple[int, np.ndarray, np.ndarray]


def descend(rows: list[Example], languages: list[str], epochs: int = 4, rate: float = 1.0, seed: int = 5) -> LanguageModel:
    """Stochastic gradient descent, one text a step, at a rate that falls to zero; languages weigh alike, whatever their share of the rows."""
    draw = np.random.default_rng(seed)
    n = len(languages)
    e = ((draw.random((BUCKETS, WIDTH)) - 0.5) * 2 / WIDTH).astype(np.float32)
    w, b = np.zeros((WIDTH, n), np.float32), np.zeros(n, np.float32)
    share = np.bincount([y for y, _, _ in rows], minlength=n)
    weight = np.clip(len(rows) / np.maximum(share, 1) / max(1, n), 0.2, 5).astype(np.float32)
    step, last = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in draw.permutation(len(rows)).tolist():
            y, bucket, part = rows[k]
            own = e[bucket]
            x = part @ own
            slope = softmax(x @ w + b)
            slope[y] -= 1
            slope *= weight[y] * rate * (1 - step / last)
            back = w @ slope
            w -= np.outer(x, slope)
            b -= 0.1 * slope
            # A bucket's share of the average is small: the step is that of a sum over the grams it holds.
            e[bucket] = own - np.outer(part * len(bucket) ** 0.5, back)
            step += 1
    return LanguageModel(languages, e, w, b)


def calibrate(model: LanguageModel, rows: list[Example], precision: float = PRECISION) -> LanguageModel:
    """Sets the temperature that makes held-out rows likeliest, then the lowest level above which `precision` of predictions are right."""
    if not rows:
        return model
    z = model.logits(np.array([part @ model.embeddings[bucket] for _, bucket, part in rows]))
    y = np.array([r[0] for r in rows])
    likely = lambda t: float(np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-30)).mean())
    model.temperature = max(np.exp(np.linspace(-3, 3, 121)).tolist(), key=likely)
    p = softmax(z / model.temperature)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top, kind="stable")
    # Equal scores are above the level together.
    good = (np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision) & np.append(np.diff(top[order]) < -1e-9, True)
    model.least = float(top[order[np.flatnonzero(good)[-1]]]) if good.any() else 1.0
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _snippet(doc_id: int, words: list[str]) -> list[str]:
    """A few words in a row, so that short texts are known too."""
    draw = np.random.default_rng(abs(doc_id))
    n = int(draw.integers(1, 9))
    at = int(draw.integers(0, max(1, len(words) - n)))
    return words[at : at + n]


_EXAMPLES = pa.schema([("lang", pa.string()), ("calibrates", pa.bool_()), ("bucket", pa.binary()), ("part", pa.binary())])


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, rows: Column | None = None) -> LanguageModel:
    """From documents with id, text and language whose id isn't held out, or that `rows`, a condition on doc_id, keeps.

    Each of at most MOST_LANGUAGES languages, the most frequent, gets the same share of sample_docs documents, chosen by a hash
    of the id, and fewer if it has fewer; the bound holds on average. Each gives its whole text and a snippet of it; one document of
    five calibrates and isn't descended on. The driver gets only their distinct subword buckets. Repeated rows count each.
    Without any such document the model knows no language.
    """
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    read = read.where("doc_id is not null and text is not null and lang is not null").where(~held_out("doc_id") if rows is None else rows)
    counts = read.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    share = {r.lang: min(1.0, sample_docs / len(counts) / r.n) for r in counts}
    of_lang = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    hashed = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = read.where(hashed < F.coalesce(of_lang[F.col("lang")], F.lit(0.0)))

    def run(got):
        def rows_() -> Iterator[tuple]:
            for batch in got:
                for i, text, lang in pairs(batch, "doc_id", "text", "lang"):
                    words = words_of(text)
                    for some in (words, _snippet(i, words)) if words else ():
                        bucket, part = counted(some)
                        yield lang, abs(i) % 5 == 0, bucket.astype("<u2").tobytes(), part.astype("<f4").tobytes()

        yield from batches(rows_(), _EXAMPLES, 256)

    got = sample.mapInArrow(run, "lang string, calibrates boolean, bucket binary, part binary").orderBy("lang", F.xxhash64("bucket", "part"), "bucket").collect()
    languages = sorted({r.lang for r in got})
    number = {x: k for k, x in enumerate(languages)}
    examples = [(r.calibrates, (number[r.lang], np.frombuffer(r.bucket, "<u2"), np.frombuffer(r.part, "<f4"))) for r in got]
    learned = [x for held, x in examples if not held] or [x for _, x in examples]
    return calibrate(descend(learned, languages), [x for held, x in examples if held])


class _Sums(dict):
    """Row of a word in `sums`: the sum of its subwords' embeddings, and their number. Words of CACHED_CHARS characters at most are kept."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.sums = np.zeros((1024, WIDTH + 1), np.float32)
        self.chars = 0

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word, the same whatever other words there are."""
        bucket, owner = subwords(words)
        order = np.argsort(owner, kind="stable")
        n = np.bincount(owner, minlength=len(words))
        out = np.empty((len(words), WIDTH + 1), np.float32)
        out[:, WIDTH] = n
        if len(words[-1]) <= LONG:
            out[:, :WIDTH] = np.add.reduceat(self.model.embeddings[bucket[order]], np.cumsum(n) - n)
        else:  # alone
            out[0, :WIDTH] = sum(self.model.embeddings[bucket[k : k + GATHERED]].sum(0) for k in range(0, len(bucket), GATHERED))
        return out

    def learn(self, texts_: list[list[str]]) -> None:
        new = sorted(filterfalse(self.__contains__, set().union(*texts_)), key=len)
        chars = sum(map(len, new))
        if self.chars + chars > CACHED_CHARS and self:
            self.clear()
            self.chars, chars = 0, 0
            self.sums = self.sums[:1024]
            return self.learn(texts_)
        self.chars += chars
        at = 0
        while at < len(new):
            # The shorter first: a group has few characters, a long word is alone.
            part = new[at : at + max(1, GATHERED // 8 // (len(new[at]) + 2))]
            while len(part) > 1 and (len(part[-1]) > LONG or len(part) * (len(part[-1]) + 2) > GATHERED // 4):
                part = part[: len(part) // 2]
            used = len(self)
            if used + len(part) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((max(len(part), len(self.sums)), WIDTH + 1), np.float32)])
            self.sums[used : used + len(part)] = self.of(part)
            self.update(zip(part, range(used, used + len(part)), strict=True))
            at += len(part)

    def average(self, words: list[str]) -> np.ndarray:
        """Of a text whose words are learned."""
        total = np.zeros(WIDTH + 1, np.float64)
        for k in range(0, len(words), GATHERED):
            part = words[k : k + GATHERED]
            total += self.sums[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0, dtype=np.float64)
        return total[:WIDTH] / total[WIDTH]


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score, accepted.

    score is the calibrated probability of lang_pred, accepted whether it reaches the model's level. A text that is null, empty or
    has no letter, and any text under a model without languages, is `und` with score 0, not accepted. Very long texts are read whole. Of languages
    equally likely the first by name is taken; a null id stays null and isn't held out; repeated rows give a row each; an
    empty table gives no rows; other columns play no part.
    """

    key = hashlib.sha256(model.embeddings.tobytes()).hexdigest()

    def run(got):
        sums = cached("language", key, lambda: _Sums(model))

        def rows() -> Iterator[tuple]:
            for batch in got:
                todo = pairs(batch, "doc_id", "text")
                while some := list(islice(todo, 16)):
                    split = [(i, words_of(t) if model.languages else []) for i, t in some]
                    sums.learn([words for _, words in split])
                    for i, words in split:
                        if not words:
                            yield i, UNKNOWN, 0.0, False
                            continue
                        p = model.probabilities(sums.average(words))
                        k = int(p.argmax())
                        yield i, model.languages[k], min(1.0, float(p[k])), bool(p[k] >= model.least)

        yield from batches(rows(), _PREDICTED)
        release_memory()

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")

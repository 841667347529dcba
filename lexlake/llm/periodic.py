"""Periodic runs of words: repeated k-grams leave the segments in which runs can lie, Main-Lorentz finds the runs there."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batches, pairs

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Segments up to this length are compared with themselves, shift by shift, instead of being halved.
LEAF = 64

#: First word, number of words, smallest period.
Run = tuple[int, int, int]


def least_overlap(least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> int:
    """The fewest words that a run has in common with itself one period on: of every period q, max(least, power * q) - q.

    Every gram of that many words in a run occurs again in the document, one period before or after, so words outside
    of repeated grams of this size are in no run. It grows with q from the period on where power * q is above least.
    """
    return min(max(least, power * q) - q for q in range(1, least + 1))


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def segments(codes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches of words that lie in k-grams which the document has more than once.

    Grams are told apart by 64 bits; should two share them by chance, a segment is longer than it need be, no run is lost.
    """
    n = len(codes) - k + 1
    if n < 2:
        return []
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    ranked = gram[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    step = np.zeros(len(codes) + 1, np.int64)
    step[:n] += again
    step[k : k + n] -= again
    inside = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def prefix_matches(x: list[int], most: int) -> list[int]:
    """For each place up to `most`, how many symbols from there on equal the first ones of x."""
    n, out, left, right = len(x), [len(x)], 0, 0
    for i in range(1, min(n, most + 1)):
        same = min(out[i - left], right - i) if i < right else 0
        if i + same >= right:
            while i + same < n and x[same] == x[i + same]:
                same += 1
            left, right = i, i + same
        out.append(same)
    return out


def matches_after(x: list[int], y: list[int], most: int) -> list[int]:
    """For each p up to `most`, how many symbols of x, from its start on, equal those of y from y's end less p on, then x's own."""
    tail = y[-most:] if most else []
    found = prefix_matches([*x, -1, *tail, *x], len(x) + 1 + len(tail))
    return [found[len(x) + 1 + len(tail) - p] for p in range(len(tail) + 1)]


def _whole(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no neighbour extends the stretch."""
    return not (start > 0 and x[start - 1] == x[start - 1 + period]) and not (end < len(x) and x[end] == x[end - period])


def _of_leaf(x: np.ndarray, lo: int, hi: int, least: int, power: int) -> Iterator[Run]:
    part = x[lo:hi]
    for p in range(1, (hi - lo) // power + 1):
        same = np.concatenate([[False], part[p:] == part[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield lo + a, b - a + p, p


def _across(x: np.ndarray, lo: int, mid: int, hi: int, power: int) -> Iterator[Run]:
    """Stretches of lo to hi that go over mid, by the matches of both halves with themselves and each other.

    A stretch of period p either repeats from mid - 1 or before to mid + p - 1 or after (read on from mid, and back from there),
    or ends before mid + p, and then the same holds in the mirror.
    """
    most = (hi - lo) // power
    left, right = x[lo:mid].tolist(), x[mid:hi].tolist()
    back, fore = left[::-1], right[::-1]
    on = prefix_matches(right, most)  # of right with itself, p on
    off = prefix_matches(back, most)
    before = matches_after(back, fore[len(fore) - min(len(fore), most) :], most)  # of left's end with what ends p after it
    after = matches_after(right, left[max(0, len(left) - most) :], most)  # of right with what starts p before it
    for p in range(1, most + 1):
        if p < len(before):
            further = on[p] if p < len(on) else 0
            if before[p] + further >= (power - 1) * p:
                yield mid - before[p], before[p] + further + p, p
        if p < len(after):
            earlier = off[p] if p < len(off) else 0
            if after[p] + earlier >= (power - 1) * p:
                yield mid - p - earlier, after[p] + earlier + p, p


def _of_segment(x: np.ndarray, least: int, power: int) -> Iterator[Run]:
    """Main-Lorentz: halves first, then what goes over the middle."""
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        if hi - lo <= LEAF:
            yield from _of_leaf(x, lo, hi, least, power)
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        yield from _across(x, lo, mid, hi, power)


def runs_of(codes: np.ndarray, least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> list[Run]:
    """Runs by start, then period: stretches of smallest period q, of max(least, power * q) words or more, that neither neighbour extends."""
    found: dict[tuple[int, int], int] = {}
    for lo, hi in segments(codes, least_overlap(least, power)):
        x = codes[lo:hi]
        for start, length, p in _of_segment(x, least, power):
            if length >= max(least, power * p) and p < found.get((lo + start, length), length) and _whole(x, start, start + length, p):
                found[lo + start, length] = p
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def longest_power(runs: list[Run]) -> Run | None:
    """The run of greatest length over period; of equals the one that starts first, then of the smallest period."""
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = s, n, p
    return best


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """False for the words of a run after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        step[s + p] += 1
        step[s + length] -= 1
    return np.cumsum(step[:-1]) == 0


_RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of the digest: for one id of ten, by its checksum, the document from a word on is one period of itself; the words' numbers."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if tenth:
        return None
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as their bytes: words are told apart by ASCII white space, nothing need be decoded."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> DataFrame:
    """One row for each input row: doc_id, n_words, runs (start, length, period), collapsed (text, each run cut to its first period where there are runs).

    A document is read whole, in one task, in n log n steps and memory of a few times its length, and no row meets
    another. A null, empty or wordless text has no words and no runs; a text without runs is returned as it is, one with
    runs as its kept words joined by one space; null ids stay null; repeated rows give a row each; an empty table
    gives no rows; other columns play no part. Of several periods of one stretch the smallest counts.
    """

    def run(got):
        def rows() -> Iterator[tuple]:
            for batch in got:
                for i, text in pairs(batch, "doc_id", "text"):
                    words = (text or b"").split()
                    runs = runs_of(word_codes(words), least, power)
                    out = b" ".join(w for w, stays in zip(words, kept(len(words), runs).tolist(), strict=True) if stays) if runs else text or b""
                    yield i, len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], out

        yield from batches(rows(), _RUNS, 256)

    out = _read(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", _text("collapsed"))


def _text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    One document of ten, by the checksum of its id, is first made periodic from one of its words on (planted_order). Edge cases
    as in periodic_runs; a null id is none of the ten, and without runs the four columns of the greatest are null.
    """

    def run(got):
        def rows() -> Iterator[tuple]:
            for batch in got:
                for i, text in pairs(batch, "doc_id", "text"):
                    words = (text or b"").split()
                    codes, order = word_codes(words), planted_order(i, len(words))
                    if order is not None:
                        words, codes = [words[k] for k in order.tolist()], codes[order]
                    runs = runs_of(codes)
                    best = longest_power(runs)
                    if runs:
                        words = [w for w, stays in zip(words, kept(len(words), runs).tolist(), strict=True) if stays]
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    yield i, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

        yield from batches(rows(), _DIGEST)

    ddl = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _read(docs, id_col, text_col).mapInArrow(run, ddl)

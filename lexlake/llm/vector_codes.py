"""Vectors as codes of their parts' nearest codebook entries; the codebooks by Elkan's form of Lloyd's rounds, in whole numbers.

Each part of each vector keeps an upper bound of the distance to its own entry and a lower bound for every entry of the
codebook. They are stored with the vectors between rounds. When entries have moved, bounds are shifted by how far, and only
entries that the triangle inequality doesn't rule out strictly are compared, by exact squared distances of whole numbers, so
ties are seen and go to the lower index. Bounds are rounded to the safe side: upper ones up to a 32-bit float, lower ones
down to a multiple of a quarter of the upper one, 4 bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import release_memory, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this are held at it, so that squared distances of parts stay within 64 bits.
LARGEST = 1 << 26
#: Rows compared at a time.
BLOCK = 4096
#: Steps of a lower bound are this part of the upper bound; 15 of them at most.
STEPS = 4


@dataclass
class Codebooks:
    """entries[part, entry, place]: whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), at most LARGEST either way."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of matching rows; either may be broadcast."""
    return ((x - c) ** 2).sum(-1)


def _up(x: np.ndarray) -> np.ndarray:
    """A 32-bit float that isn't below x."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """Not above x, whatever the last digits of a root or a sum are."""
    return np.maximum(x * (1 - 1e-12) - 1e-9, 0)


@dataclass
class Bounds:
    """Of n parts: own entry, upper bound to it, steps of the lower bound to each entry (n x entries)."""

    code: np.ndarray
    upper: np.ndarray
    steps: np.ndarray

    def lower(self) -> np.ndarray:
        return self.steps * (_down(self.upper.astype(np.float64)) / STEPS)[:, None]


def _steps(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    return np.minimum(_down(lower) * STEPS / np.maximum(upper.astype(np.float64), 1e-3)[:, None], 15).astype(np.uint8) * (upper > 1e-3)[:, None]


def first_bounds(x: np.ndarray, entries: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """Every entry compared: bounds, and the squared distance to the nearest."""
    d = np.empty((len(x), len(entries)), np.int64)
    for k in range(len(entries)):
        d[:, k] = squared(x, entries[k])
    code = d.argmin(1)
    error = d[np.arange(len(x)), code]
    upper = _up(np.sqrt(error))
    return Bounds(code, upper, _steps(np.sqrt(d), upper)), error


@dataclass
class Step:
    """What a round knows of one part's entries: as they are, how far each has moved, half the distances between them."""

    entries: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray) -> Step:
        between = np.sqrt(squared(entries[:, None, :], entries[None, :, :]))
        return cls(entries, np.sqrt(squared(entries, before)) * (1 + 1e-12), _down(between / 2))


def next_bounds(x: np.ndarray, b: Bounds, step: Step) -> tuple[Bounds, np.ndarray, int]:
    """Bounds after the entries have moved, squared distances to the nearest, and how many distances were computed.

    An entry is ruled out where its lower bound, or half its distance from the own entry, is strictly above the upper bound:
    then it is strictly further away, so no tie is lost.
    """
    n, row = len(x), np.arange(len(x))
    lower = _down(b.lower() - step.moved)
    upper = (b.upper.astype(np.float64) + step.moved[b.code]) * (1 + 1e-12)
    open_ = (lower <= upper[:, None]) & (step.half[b.code] <= upper[:, None])
    open_[row, b.code] = False
    some = np.flatnonzero(open_.any(1))
    own = squared(x, step.entries[b.code])  # the own distance is wanted in any case, as the error
    exact = np.sqrt(own)
    tight = np.minimum(upper, exact * (1 + 1e-12))
    at, k = np.nonzero(open_[some] & (lower[some] <= tight[some, None]) & (step.half[b.code[some]] <= tight[some, None]))
    at = some[at]
    d = squared(x[at], step.entries[k])
    best = own.copy()
    np.minimum.at(best, at, d)
    # The lowest index of those at the smallest distance, the own one among them.
    code = np.where(own == best, b.code, len(step.entries))
    hit = d == best[at]
    np.minimum.at(code, at[hit], k[hit])
    lower[row, b.code] = _down(exact)
    lower[at, k] = _down(np.sqrt(d))
    new = _up(np.sqrt(best))
    return Bounds(code, new, _steps(lower, new)), best, len(at) + n


_FLAT = "vec_id long, label long, x array<int>"
_STATE = _FLAT + ", code binary, upper binary, steps binary"
_STATE_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.int32())), ("code", pa.binary()), ("upper", pa.binary()), ("steps", pa.binary())])
_FLAT_SCHEMA = pa.schema(list(_STATE_SCHEMA)[:3])
_CODED_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.binary()), ("error", pa.int64())])
_SUMS_SCHEMA = pa.schema([("at", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])


def _finite(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(f"`{label_col}`") if label_col else F.lit(None)).cast("long").alias("label"), v.alias("v"))
    return rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _matrix(column: pa.ListArray, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)


def first_vectors(rows: DataFrame, most: int) -> list[tuple[int, list[float]]]:
    """The vectors of the `most` smallest ids, by id; of several under one id the smallest. Null ids come last, as one id.

    A task keeps that many rows and sends no more.
    """

    def run(got):
        held: dict[tuple, list[float]] = {}
        last = None  # no id after it can be among the first
        for batch in got:
            for k, i in enumerate(batch.column(0).to_pylist()):
                key = (i is None, i or 0)
                if last is not None and key > last:
                    continue
                v = batch.column(1)[k].as_py()
                held[key] = min(v, held.get(key, v))
                if len(held) >= 4 * most:
                    held = {x: held[x] for x in sorted(held)[:most]}
                    last = max(held)
        first = sorted(held)[:most]
        yield pa.RecordBatch.from_arrays([pa.array([None if null else i for null, i in first], pa.int64()), pa.array([held[x] for x in first], pa.list_(pa.float64()))], names=["vec_id", "v"])

    small = rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>")
    got = small.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).limit(most).collect()
    return [(r.vec_id, r.v) for r in got]


def _padded(width: int, parts: int) -> int:
    return -(-max(width, 1) // parts) * parts


def _numbered(rows: DataFrame, width: int, padded: int) -> DataFrame:
    """Vectors of `width` components as whole numbers, with zeros up to `padded`; others are left out."""

    def run(got):
        for batch in got:
            x = np.zeros((batch.num_rows, padded), np.int64)
            if width and batch.num_rows:
                x[:, :width] = whole_numbers(_matrix(batch.column(2), width, np.float64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * padded, pa.int32()), pa.array(x.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], schema=_FLAT_SCHEMA)

    return rows.where(F.size("v") == width).mapInArrow(run, _FLAT)


def _blocks(batch: pa.RecordBatch, parts: int, padded: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for k in range(0, batch.num_rows, BLOCK):
        part = batch.slice(k, BLOCK)
        yield part, _matrix(part.column(2), padded, np.int64).reshape(part.num_rows, parts, -1)


def _bytes(column: pa.Array, dtype, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _packed(steps: np.ndarray) -> np.ndarray:
    """Two steps to a byte, an odd last one alone."""
    if steps.shape[-1] % 2:
        steps = np.concatenate([steps, np.zeros((*steps.shape[:-1], 1), np.uint8)], -1)
    return steps[..., ::2] | steps[..., 1::2] << 4


def _unpacked(packed: np.ndarray, n: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], -1).reshape(*packed.shape[:-1], -1)[..., :n]


def _rows_of(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _state(part: pa.RecordBatch, found: list[Bounds]) -> pa.RecordBatch:
    code, upper, steps = (np.stack([getattr(b, name) for b in found], 1) for name in ("code", "upper", "steps"))
    return pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), _rows_of(code.astype(np.uint8)), _rows_of(upper.astype("<f4")), _rows_of(_packed(steps))], schema=_STATE_SCHEMA)


def _bounds(part: pa.RecordBatch, parts: int, n: int) -> list[Bounds]:
    code, upper = _bytes(part.column(3), np.uint8, (parts,)), _bytes(part.column(4), "<f4", (parts,))
    steps = _unpacked(_bytes(part.column(5), np.uint8, (parts, -(-n // 2))), n)
    return [Bounds(code[:, p].astype(np.int64), upper[:, p], steps[:, p]) for p in range(parts)]


def _first_round(rows: DataFrame, books: np.ndarray) -> DataFrame:
    def run(got):
        for batch in got:
            for part, x in _blocks(batch, len(books), books.shape[0] * books.shape[2]):
                yield _state(part, [first_bounds(x[:, p], books[p])[0] for p in range(len(books))])
        release_memory()

    return rows.mapInArrow(run, _STATE)


def _next_round(state: DataFrame, books: np.ndarray, before: np.ndarray, last: bool) -> DataFrame:
    """The state under moved entries or, in the end, vec_id, label, code, error."""
    steps = [Step.of(c, b) for c, b in zip(books, before, strict=True)]

    def run(got):
        for batch in got:
            for part, x in _blocks(batch, len(books), books.shape[0] * books.shape[2]):
                found = [next_bounds(x[:, p], b, steps[p]) for p, b in enumerate(_bounds(part, len(books), books.shape[1]))]
                if not last:
                    yield _state(part, [f[0] for f in found])
                    continue
                code = np.stack([f[0].code for f in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _rows_of(code), pa.array(sum(f[1] for f in found))], schema=_CODED_SCHEMA)
        release_memory()

    return state.mapInArrow(run, "vec_id long, label long, code binary, error long" if last else _STATE)


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as floor(sum / count) of their parts; unused ones stay. A task sends a row for each number of the codebooks."""
    parts, n, width = books.shape

    def run(got):
        counts, totals = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in got:
            for part, x in _blocks(batch, parts, parts * width):
                code = _bytes(part.column(3), np.uint8, (parts,))
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=n)
                    for k in range(width):
                        np.add.at(totals[p, :, k], code[:, p], x[:, p, k])
        at = np.flatnonzero(np.repeat(counts.ravel(), width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(counts.ravel(), width)[at]), pa.array(totals.ravel()[at])], schema=_SUMS_SCHEMA)

    sums = state.select("vec_id", "label", "x", "code").mapInArrow(run, "at long, n long, total long")
    out = books.copy().ravel()
    for r in sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["at"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def fit_and_encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every vector, and the codebooks; code has a byte for each part, entries are 256 at most.

    Vectors that are null or hold a null or non-finite component are dropped, as are those of another length than the first
    kept id's, which sets the codebooks; a length that isn't a multiple of `parts` gets zeros at its end. Components beyond LARGEST
    are held at it. Of several vectors of one id the smallest starts an entry, all are encoded; null ids count as one, after all others.
    With fewer ids there are fewer entries; equal distances go to the lower index; an empty table gives no rows; other
    columns play no part. The driver gets the codebooks and as many first vectors, no more; the state of a round is stored
    in the shared folder, so a lost executor costs its own tasks.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    rows = _finite(vectors, id_col, vector_col, label_col)
    first = first_vectors(rows, entries)
    width = len(first[0][1]) if first else 0
    first = [v for _, v in first if len(v) == width]
    padded = _padded(width, parts)
    seed = np.zeros((max(len(first), 1), padded), np.int64)
    if first and width:
        seed[:, :width] = whole_numbers(np.array(first))
    books = np.ascontiguousarray(seed.reshape(len(seed), parts, -1).transpose(1, 0, 2))
    numbered = _numbered(rows, width, padded)
    state, before = stored(_first_round(numbered, books)), books
    for k in range(rounds):
        if k:
            state = stored(_next_round(state, books, before, last=False))
        before, books = books, _updated(state, books)
    return stored(_next_round(state, books, before, last=True)), Codebooks(books)


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """The rows with `decoded`: the entries that a code names, divided by SCALE. A null code decodes to null."""
    entries = books.entries

    def run(got):
        for batch in got:
            codes = batch.column(batch.schema.get_field_index(code_col)).to_pylist()
            out = [None if c is None else (entries[np.arange(len(entries)), np.frombuffer(c, np.uint8)].ravel() / SCALE).tolist() for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "decoded"])

    kept = coded.select(*(F.col(f"`{c}`") for c in coded.columns if c != "decoded"))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.ArrayType(T.DoubleType()))]))


def code_digest(vectors: DataFrame, **kinds: str) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over equal labels, nulls together), codebooks_sha256; edge cases as above."""
    coded, books = fit_and_encode(vectors, **kinds)
    label: Callable = lambda c: (F.col(c).isNull(), F.coalesce(c, F.lit(0)))
    total = coded.groupBy(*(x.alias(n) for n, x in zip(("unlabelled", "of"), label("label"), strict=True))).agg(F.sum("error").alias("label_error"))
    rows = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", *(x.alias(n) for n, x in zip(("unlabelled", "of"), label("label"), strict=True)))
    return rows.join(total, ["unlabelled", "of"]).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

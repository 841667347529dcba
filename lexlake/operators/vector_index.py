"""Approximate vector search: an inverted file of cells, their vectors as residual codes, probed cell by cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .retrieval import top_per

#: Vectors that the cells are fitted on, queries on which the number of probes is, at most; rows of a block.
SAMPLE, TRIAL, BLOCK = 20_000, 200, 2048
#: Candidates by code that go on to the exact comparison, as a multiple of k.
SPARE = 4


@dataclass
class Cells:
    """Unit vectors of the cells, and how many of them a query probes."""

    centres: np.ndarray
    probes: int


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(-1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x))").select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))


def spherical_means(x: np.ndarray, n: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """n unit vectors near which the rows of x lie, by Lloyd's rounds; an empty one stays."""
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        used = np.bincount(near, minlength=len(centres)) > 0
        centres[used] = unit(sums[used])
    return centres


def fit_cells(vectors: DataFrame, k: int = 10, recall: float = 0.97, n_cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Cells and probes from at most `sample` vectors, those of the smallest hash of their id; the index covers all rows all the same.

    n_cells is the root of the number of all vectors unless given, 4,096 at most. The probes are the fewest with which as many queries of the
    sample's own find `recall` of their k nearest in the sample.
    """
    rows = _usable(vectors)
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not got:
        return Cells(np.zeros((0, 0)), 1)
    x = unit(np.array([r.v for r in got]))
    n = n_cells or max(1, min(4096, int(rows.count() ** 0.5)))
    centres = spherical_means(x, n)
    near, asked = (x @ centres.T).argmax(1), x[:TRIAL]
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    best = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    # The probe at which each of a query's nearest is met.
    at = np.take_along_axis(place, near[best], 1)
    share = np.array([(at <= p).mean() for p in range(len(centres))])
    return Cells(centres, int(np.argmax(share >= min(recall, share[-1]))) + 1)


_BLOCKS = "cell int, n int, ids binary, scales binary, codes binary"


def index_vectors(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(cell, n, ids, scales, codes) blocks of (id, v): what a vector differs by from its cell's centre, a byte for each component and one scale.

    Every row is in the cell of the nearest centre; null vectors and ids are left out. A block has BLOCK rows at most, so a cell of any size
    is many rows of the table.
    """
    centres = cells.centres

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            near = (x @ centres.T).argmax(1)
            rest = x - centres[near]
            scale = np.maximum(np.abs(rest).max(1) / 127, 1e-12)
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            order = np.argsort(near, kind="stable")
            out = []
            for cell in np.unique(near):
                mine = order[near[order] == cell]
                for a in range(0, len(mine), BLOCK):
                    some = mine[a : a + BLOCK]
                    out.append((int(cell), len(some), ids[some].astype("<i8").tobytes(), scale[some].astype("<f4").tobytes(), code[some].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["cell", "n", "ids", "scales", "codes"])

    return _usable(vectors).repartition(F.pmod(F.xxhash64("id"), F.lit(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(run, _BLOCKS)


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("near", pa.float64())])


def probe(index: DataFrame, vectors: DataFrame, queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, id, score, rank): the best k of each query (query_id, q) among the cells that it probes, by exact cosine of the candidates, ties by id.

    A query goes to its probes as a row each; queries of a cell meet its blocks in packs, each pair is one product of the codes. The best SPARE * k by
    code of each query are then compared exactly with their vectors (id, v), found by id.
    """
    centres, probes = cells.centres, min(cells.probes, max(1, len(cells.centres)))

    def dealt(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            q = _matrix(batch.column(1))
            if not len(q) or not len(centres):
                continue
            some = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
            packs: dict[int, list[int]] = {}
            for row, near in enumerate(some.tolist()):
                for cell in near:
                    packs.setdefault(cell, []).append(row)
            ids = batch.column(0).to_numpy()
            out = [(cell, len(rows[a : a + BLOCK]), ids[rows[a : a + BLOCK]].astype("<i8").tobytes(), q[rows[a : a + BLOCK]].astype("<f4").tobytes()) for cell, rows in packs.items() for a in range(0, len(rows), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["cell", "m", "query_ids", "q"])

    def scored(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            for cell, n, ids, scales, codes, m, query_ids, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                q = np.frombuffer(q, "<f4").reshape(m, -1)
                rest = np.frombuffer(codes, np.int8).reshape(n, -1) * np.frombuffer(scales, "<f4")[:, None]
                near = (q @ centres[cell].astype("f4"))[:, None] + q @ rest.T.astype("f4")
                order = np.lexsort((np.broadcast_to(ids, near.shape), -near))[:, : SPARE * k]
                out = [np.repeat(query_ids, order.shape[1]), ids[order].ravel(), np.take_along_axis(near, order, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    asked = _usable(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v")))
    packs = asked.mapInArrow(dealt, "cell int, m int, query_ids binary, q binary")
    met = index.join(packs, "cell").select("cell", "n", "ids", "scales", "codes", "m", "query_ids", "q")
    some = top_per(met.mapInArrow(scored, "query_id long, id long, near double"), ["query_id"], [F.desc("near"), F.asc("id")], SPARE * k, "place")
    some = stored(some.select("query_id", "id"))
    rows = some.join(_usable(vectors), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q"))
    exact = rows.select("query_id", "id", F.round(F.when(length > 0, dot("v", "q") / length).otherwise(0.0), 6).alias("score"))
    return top_per(exact, ["query_id"], [F.desc("score"), F.asc("id")], k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n, recall) of two tables (query_id, id): the share of the exact one's rows that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))

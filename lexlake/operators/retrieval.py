"""Retrieval: postings, BM25, exact vector search, rank fusion, tiers, budgets, citations, quality metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60
#: Parts into which the queries that ask for a term are dealt.
SALTS = 16


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, text_col: str, stop: DataFrame | None = None, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, term, tf, doc_len): one shuffle, counts summed up before it. Words of `stop` (term) are left out, and don't
    count as length; `stem` turns words into terms. Store the rows if several steps read them."""
    words = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("w"))
    if stop is not None:
        # A list of words of a language: a few hundred.
        words = words.crossJoin(F.broadcast(stop.agg(F.collect_set("term").alias("stop")))).select("id", F.filter("w", lambda x: ~F.array_contains("stop", x)).alias("w"))
    if stem is not None:
        words = words.select("id", F.transform("w", stem).alias("w"))
    each = words.select("id", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return each.groupBy("id", "term", "doc_len").agg(F.count("*").alias("tf"))


def bm25_topk(post: DataFrame, n_docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank): Okapi BM25 of each query's distinct terms, best k, ties by id.

    queries: (query_id, term). Only postings of asked terms are scored; a term's frequency is counted over all documents.
    n_docs: one row (n, avg_len). A term that many documents or queries have is a hot key: each posting meets the asking
    queries packed into one array for each SALT, so the join has a row for each posting and salt, and its output is
    summed up by query and document right after, before any shuffle.
    """
    asked = queries.select("query_id", "term").distinct()
    salt = F.pmod(F.xxhash64("query_id"), F.lit(SALTS))
    packed = asked.groupBy("term", salt.alias("salt")).agg(F.collect_list("query_id").alias("query_ids"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    # One row, so of a fixed size.
    idf = df.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(n_docs)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avg_len")
    weighed = packed.join(idf, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    hit = post.join(weighed, "term").select("id", part.alias("part"), F.explode("query_ids").alias("query_id"))
    total = hit.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_per(total, ["query_id"], [F.desc("score"), F.asc("id")], k)


def corpus_size(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.size(terms(F.col(text_col))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


#: Vectors in a block: what two of them give fits into a task's memory many times over.
BLOCK = 2048
_BLOCK = "n int, ids binary, vectors binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """(n, ids, vectors) of (id, v): up to BLOCK rows of a partition each, as bytes, scaled to length 1. Null vectors are left out."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            for k in range(0, batch.num_rows, BLOCK):
                ids, column = batch.column(0).slice(k, BLOCK), batch.column(1).slice(k, BLOCK)
                v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
                length = np.sqrt((v * v).sum(1, keepdims=True))
                out = [[len(v)], [ids.to_numpy().astype("<i8").tobytes()], [(v / np.where(length > 0, length, 1)).astype("<f8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["n", "ids", "vectors"])

    return rows.where("id is not null and v is not null").select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, _BLOCK)


_SCORED = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact cosine of every query against every vector, best k, ties by id.

    vectors: (id, v); queries: (query_id, q), a stated set. Both sides are packed into blocks, each pair of blocks is one
    matrix product, and of each only the best k for a query go on: rows that meet are blocks, some thousand times fewer
    than the pairs that are scored. Vectors of length 0 score 0.
    """

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            for n, ids, v, m, query_ids, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                score = np.round(np.frombuffer(q, "<f8").reshape(m, -1) @ np.frombuffer(v, "<f8").reshape(n, -1).T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score))[:, :k]
                found = [np.repeat(query_ids, order.shape[1]), ids[order].ravel(), np.take_along_axis(score, order, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_SCORED)

    mine = _blocks(vectors.select("id", "v"))
    asked = _blocks(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"))).toDF("m", "query_ids", "q")
    # Spark broadcasts the queries' blocks only if it finds them small enough; else pairs of blocks are dealt out.
    scored = mine.crossJoin(asked).mapInArrow(run, "query_id long, id long, score double")
    return top_per(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; the limit is pushed below the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def rank_fusion(branches: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): reciprocal ranks of each branch (query_id, id, rank) summed, best k. A branch without rows adds nothing."""
    both = branches[0].select("query_id", "id", "rank")
    for other in branches[1:]:
        both = both.unionByName(other.select("query_id", "id", "rank"))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"))
    return top_per(fused, ["query_id"], [F.desc("score"), F.asc("id")], k)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """New scores replace the old; equal ones keep the upstream order; best k of each query."""
    new = hits.withColumn("score", score).withColumnRenamed("rank", "upstream_rank")
    return top_per(new, ["query_id"], [F.desc("score"), F.asc("upstream_rank")], k)


def merge_tiers(tiers: list[DataFrame], cap: int) -> DataFrame:
    """Tiers (query_id, id, rank) in order of precedence: an id stays where it first comes, at most `cap` of a query."""
    all_ = None
    for t, df in enumerate(tiers):
        one = df.select("query_id", "id", "rank", F.lit(t).alias("tier"))
        all_ = one if all_ is None else all_.unionByName(one)
    first = all_.groupBy("query_id", "id").agg(F.min(F.struct("tier", "rank")).alias("at"))
    placed = first.select("query_id", "id", "at.tier", F.col("at.rank").alias("tier_rank"))
    return top_per(placed, ["query_id"], [F.asc("tier"), F.asc("tier_rank"), F.asc("id")], cap, "position")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per(df, keys, order, 1, "_first").drop("_first")


def within_budget(hits: DataFrame, keys: list[str], order: list[Column], chars: Column, budget: int) -> DataFrame:
    """Rows until the running cost passes the budget: a row costs a quarter of its characters, at least 1, so the first overflow ends the output.

    As each row costs 1 or more, only the first `budget` rows of a key can count, and the others go before the shuffle."""
    cost = F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")
    some = top_per(hits.withColumn("cost", cost), keys, order, budget, "_place").drop("_place")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= budget)


def citation_frequency(refs: DataFrame, present: DataFrame) -> DataFrame:
    """refs: (hit_id, pos, target). How many hits cite each target that is not present itself; most cited first, then first seen."""
    per_hit = refs.groupBy("hit_id", "target").agg(F.min("pos").alias("pos"))
    cited = per_hit.groupBy("target").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return cited.join(present, "target", "left_anti")


def guardrail(markers: DataFrame, hits: DataFrame) -> DataFrame:
    """markers: (marker, act, article, paragraph); hits: (act, article, paragraphs). Verdict of each marker:
    ok, unknown_act, unknown_article, or unknown_paragraph (advisory: still verified)."""
    flat = hits.groupBy("act", "article").agg(F.array_distinct(F.flatten(F.collect_set("paragraphs"))).alias("paragraphs"))
    acts = flat.select("act").distinct().withColumn("has_act", F.lit(True))
    got = markers.join(acts, "act", "left").join(flat.withColumn("has_article", F.lit(True)), ["act", "article"], "left")
    reason = F.when(F.col("has_act").isNull(), "unknown_act").when(F.col("article").isNotNull() & F.col("has_article").isNull(), "unknown_article")
    reason = reason.when(F.col("paragraph").isNotNull() & ~F.coalesce(F.array_contains("paragraphs", F.col("paragraph")), F.lit(False)), "unknown_paragraph").otherwise("ok")
    return got.select("marker", "act", "article", "paragraph", reason.alias("reason")).withColumn("verified", F.col("reason").isin("ok", "unknown_paragraph"))


def first_hit_rank(hits: DataFrame, relevant: Column) -> DataFrame:
    """(query_id, first_rank): of the first relevant hit, null if none is."""
    return hits.groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))


def quality(ranks: DataFrame, kind: str) -> DataFrame:
    """recall@5, recall@10 and mean reciprocal rank by kind and overall (kind null), in one pass."""
    at = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6)
    mrr = F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6)
    return ranks.rollup(kind).agg(F.count("*").alias("n"), at(5).alias("recall_5"), at(10).alias("recall_10"), mrr.alias("mrr"))

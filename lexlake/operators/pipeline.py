"""Composite retrieval: explicit references, hybrid hits, citations one hop on, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..streaming.markers import marker_acts
from . import retrieval as rt
from .citations import with_references
from .prose import cited_by

ARTICLE_CAP, ACT_CAP, SUPPLEMENT_CAP, EXTRA = 12, 5, 2, 4


def resolved(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, ref_no, k, chunk_id, by_article): an article's first chunks, or an act's first in legal order. A chunk
    counts for its first reference only; chunks without id are all kept."""
    key = ["act_ref", "article"]
    by_article = refs.where("article is not null").select("query_id", "ref_no", *key).join(chunks.select("chunk_id", "split_no", *key), key)
    a = rt.top_per(by_article, ["query_id", "ref_no"], [F.asc("split_no"), F.asc("chunk_id")], ARTICLE_CAP, "k")
    by_act = refs.where("article is null").select("query_id", "ref_no", "act_ref").join(chunks.select("chunk_id", "act_ref", "legal_no"), "act_ref")
    b = rt.top_per(by_act, ["query_id", "ref_no"], [F.asc("legal_no"), F.asc("chunk_id")], ACT_CAP, "k")
    both = a.select("query_id", "ref_no", "k", "chunk_id", F.lit(True).alias("by_article")).unionByName(b.select("query_id", "ref_no", "k", "chunk_id", F.lit(False).alias("by_article")))
    again = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("ref_no", "k"))
    return both.withColumn("again", again).where("again = 1 or chunk_id = ''").drop("again")


def resolve(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, by_article) of what is resolved; score counts as 1."""
    rank = F.row_number().over(Window.partitionBy("query_id", "by_article").orderBy("ref_no", "k"))
    return resolved(refs, chunks).withColumn("rank", rank).select("query_id", "chunk_id", "rank", "by_article")


def existing(refs: DataFrame, acts: DataFrame | None) -> DataFrame:
    """References whose act is known, if acts (act_ref) are given: of those whose key was made of number and year
    (computed) the act must be there, others pass."""
    if acts is None:
        return refs
    found = refs.where("computed").join(acts.select("act_ref").distinct(), "act_ref", "left_semi")
    return found.select(*refs.columns).unionByName(refs.where("not computed"))


def bind_unbound(refs: DataFrame, context: DataFrame) -> DataFrame:
    """References (query_id, act_ref, article, ...) without act take the one act that the others of the query name, or,
    if none names any, the one of its context (query_id, act_ref); with none or several they are dropped."""
    named = refs.where("act_ref is not null").select("query_id", "act_ref").distinct()
    given = context.select("query_id", "act_ref").distinct().join(named.select("query_id").distinct(), "query_id", "left_anti")
    one = named.unionByName(given).groupBy("query_id").agg(F.count("*").alias("n"), F.min("act_ref").alias("only")).where("n = 1").select("query_id", "only")
    got = refs.join(one, "query_id", "left").withColumn("act_ref", F.coalesce("act_ref", F.when(F.col("article").isNotNull(), F.col("only"))))
    return got.where("act_ref is not null").select(*refs.columns)


def turn_references(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, context) of conversations (conv_id, turn, role, text): the references of the last user turn, numbered, and
    the acts that markers of the last assistant turn name. query_id is the conversation's."""
    last = lambda role: turns.where(F.col("role") == role).groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("text"))
    each = with_references(last("user"), "text", "all").select("query_id", F.posexplode("all").alias("ref_no", "r"))
    refs = each.select("query_id", "ref_no", "r.act_ref", "r.article", "r.comma", F.col("r.year").isNotNull().alias("computed"))
    context = last("assistant").select("query_id", F.explode(marker_acts(F.col("text"))).alias("act_ref"))
    return refs, context


def answer_context(turns: DataFrame, chunks: DataFrame, hybrid: DataFrame, k: int, budget: int, acts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, tier, position) of what an answer to each conversation's last user turn is given: chunks of explicit
    references, hybrid hits (query_id, id, rank), two chunks of acts that are only named, then what those texts cite.

    chunks: (chunk_id, act_ref, article, split_no, legal_no, text). Tiers are 0 to 2, and 3 for what is cited.
    """
    refs, context = turn_references(turns)
    bound = existing(bind_unbound(refs, context), acts)
    first = stored(retrieve(bound, chunks, hybrid, k))
    hits = first.join(chunks.select(F.col("chunk_id").alias("id"), "act_ref", "article", "text"), "id").withColumnRenamed("id", "chunk_id")
    cited = follow_citations(hits, chunks, budget, acts)
    ends = first.groupBy("query_id").agg(F.max("position").alias("last"))
    more = cited.join(ends, "query_id").select("query_id", F.col("chunk_id").alias("id"), F.lit(3).alias("tier"), (F.col("last") + F.col("place")).alias("position"))
    return first.unionByName(more)


def retrieve(refs: DataFrame, chunks: DataFrame, hybrid: DataFrame, k: int) -> DataFrame:
    """(query_id, id, tier, position): article hits, hybrid hits (query_id, id, rank), two act hits, each chunk once, k + EXTRA at most."""
    exact = resolve(refs, chunks).withColumnRenamed("chunk_id", "id")
    return rt.merge_tiers([exact.where("by_article"), hybrid, exact.where(f"not by_article and rank <= {SUPPLEMENT_CAP}")], k + EXTRA).select("query_id", "id", "tier", "position")


def two_tier_search(refs: DataFrame, chunks: DataFrame, hybrid: DataFrame, k: int) -> DataFrame:
    """Article hits first, filled up to k by hybrid ones."""
    exact = resolve(refs.where("article is not null"), chunks).withColumnRenamed("chunk_id", "id")
    return rt.merge_tiers([exact, hybrid], k).select("query_id", "id", "tier", "position")


def follow_citations(hits: DataFrame, chunks: DataFrame, budget: int, acts: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, place, spent): chunks that the hits cite, most cited first, until one passes the token budget.

    hits: (query_id, chunk_id, position, act_ref, article, text). A target counts each different reference of each hit;
    ties go by where it is first seen. Articles among the hits, and acts of which any hit is, are not targets; chunks
    among the hits are not given again. One hop: what is found isn't followed, so there is no recursion.
    """
    cited = cited_by(hits).where("act_ref is not null")
    counted = cited.groupBy("query_id", "act_ref", "article").agg(F.count("*").alias("n"), F.min(F.struct("position", "pos")).alias("first"), F.max("computed").alias("computed"))
    articles = counted.where("article is not null").join(hits.select("query_id", "act_ref", "article").distinct(), ["query_id", "act_ref", "article"], "left_anti")
    whole = counted.where("article is null").join(hits.select("query_id", "act_ref").distinct(), ["query_id", "act_ref"], "left_anti")
    fresh = existing(articles.select(*counted.columns).unionByName(whole.select(*counted.columns)), acts)
    order = [F.desc("n"), F.asc("first"), F.asc("act_ref"), F.asc("article")]
    refs = fresh.withColumn("ref_no", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    found = resolved(refs, chunks).join(hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    texts = found.join(chunks.select("chunk_id", "text"), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ref_no", "k"))
    return rt.within_budget(texts, ["query_id"], [F.asc("ref_no"), F.asc("k")], F.length("text"), budget).withColumn("place", place).select("query_id", "chunk_id", "place", "spent")


def source_list(hits: DataFrame) -> DataFrame:
    """(act, article) pairs of the hits of each query, each once, in the order of their first hit."""
    first = hits.groupBy("query_id", "act_ref", "article").agg(F.min("position").alias("position"))
    return first.withColumn("source_no", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "act_ref", "article")))


def article_window(articles: DataFrame, wanted: DataFrame, order: list[Column]) -> DataFrame:
    """(act_ref, article, pos, occurrence, wanted): the first article of a wanted number (act_ref, article) of each act and
    those right before and after it, by position; an act without such an article gives none."""
    act = Window.partitionBy("act_ref").orderBy(*order)
    placed = articles.withColumn("pos", F.row_number().over(act)).withColumn("occurrence", F.row_number().over(Window.partitionBy("act_ref", "article").orderBy(*order)))
    at = placed.where("occurrence = 1").join(wanted.select("act_ref", "article"), ["act_ref", "article"]).select("act_ref", F.col("article").alias("wanted"), F.explode(F.array(*(F.col("pos") + k for k in (-1, 0, 1)))).alias("pos"))
    return placed.join(at, ["act_ref", "pos"]).select("act_ref", "article", "pos", "occurrence", "wanted")

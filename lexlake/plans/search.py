"""Registered queries about the stored index: Italian terms, and an index that a change feed goes into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import italian
from ..operators import inverted as iv
from ..operators import pipeline as pl
from ..operators import retrieval as rt
from ..operators import vector_index as vi
from ..sources.scratch import shared_folder, stored
from .queries import _BM25, _POST, Tables, _index, query


@query(None)
def bm25_italian(t: Tables) -> DataFrame:
    """RET-02: stop words left out, words filed under their Italian stems, on both sides by the same function."""
    docs = t("documents")
    asked = iv.asked_terms(docs.where("doc_id % 100 = 0"), "doc_id", "text", italian.term)
    return iv.search(_index(docs, italian.term), asked, 10)


_CHANGED = "SELECT doc_id, lang, CASE WHEN doc_id % 5 = 1 THEN concat(text, ' nuovo testo') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3"


@query(f"""WITH {_POST.replace('FROM documents', f'FROM ({_CHANGED})')}, df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), {_BM25.format(post='post', k=10)} SELECT query_id, id, score, rank FROM b""")
def index_after_feed(t: Tables) -> DataFrame:
    """RET-02, ING-05: an index of nine tenths of the documents, into which a feed of new, edited and deleted ones goes: dead
    ones count no more, and nothing that stayed is indexed again."""
    docs = t("documents").select("doc_id", "text")
    folder = shared_folder(docs.sparkSession)
    iv.write_index(iv.blocks(docs.where("doc_id % 10 <> 0"), "doc_id", "text"), folder, 8)
    text = F.when(F.col("doc_id") % 7 == 3, None).when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" nuovo testo"))).otherwise(F.col("text"))
    feed = docs.where("doc_id % 7 = 3 or doc_id % 5 = 1 or doc_id % 10 = 0").select("doc_id", text.alias("text"))
    added, dead = iv.updated(iv.read_index(docs.sparkSession, folder), None, feed, "doc_id", "text")
    iv.write_index(added, folder, 8)
    asked = iv.asked_terms(docs.select("doc_id", text.alias("text")).where("doc_id % 100 = 0 and text is not null"), "doc_id", "text")
    return iv.search(iv.read_index(docs.sparkSession, folder), asked, 10, dead=dead)


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e, e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@query(None)
def ivf_topk(t: Tables) -> DataFrame:
    """RET-01: approximate search over an inverted file of residual codes; every vector is indexed."""
    vectors, asked = _vectors(t)
    cells = vi.fit_cells(vectors)
    return vi.probe(stored(vi.index_vectors(vectors, cells)), vectors, asked, cells, 10)


@query("""SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) * 10 AS n, true AS enough""")
def ivf_recall(t: Tables) -> DataFrame:
    """RET-01: how many of the exact ten nearest of each query the approximate search finds, at least 0.95 of all."""
    vectors, asked = _vectors(t)
    cells = vi.fit_cells(vectors)
    found = vi.probe(stored(vi.index_vectors(vectors, cells)), vectors, asked, cells, 10)
    return vi.recall_of(found, rt.cosine_topk(vectors, asked, 10)).select("n", (F.col("recall") >= 0.95).alias("enough"))


@query("""WITH x AS (SELECT doc_id, concat(text, ' di cui all''articolo ', doc_id + 1, ' e all''art. ', doc_id + 2, ' della legge 7 agosto 1990, n. 241 ') AS text FROM documents),
q AS (SELECT DISTINCT conv_id AS query_id, conv_id % 50 + 1 AS k, conv_id * 7 % 30 + 60 AS h FROM conversations WHERE role = 'user'),
c AS (SELECT query_id, unnest([k + 1, k + 2, h + 1, h + 2]) AS doc_id, unnest([1, 2, 3, 4]) AS place FROM q),
s AS (SELECT query_id, c.doc_id, place, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY query_id ORDER BY place) AS spent FROM c JOIN x ON x.doc_id = c.doc_id)
SELECT query_id, k::VARCHAR AS id, 0::BIGINT AS tier, 1::BIGINT AS position FROM q UNION ALL SELECT query_id, h::VARCHAR, 1, 2 FROM q UNION ALL SELECT query_id, doc_id::VARCHAR, 3, 2 + place FROM s WHERE spent <= 6000""")
def answer_context(t: Tables) -> DataFrame:
    """RET-12, EXT-07: what an answer to each conversation's last user turn is given: the article that the turn names, a hit of the search, and
    what both cite, documents being the articles of one act."""
    n = F.col("doc_id")
    cite = F.concat(F.lit(" di cui all'articolo "), (n + 1).cast("string"), F.lit(" e all'art. "), (n + 2).cast("string"), F.lit(" della legge 7 agosto 1990, n. 241 "))
    chunks = t("documents").select(n.cast("string").alias("chunk_id"), F.lit("legge-241-1990").alias("act_ref"), n.cast("string").alias("article"), F.lit(0).alias("split_no"), n.alias("legal_no"), F.concat("text", cite).alias("text"))
    asked = F.concat(F.coalesce("text", F.lit("")), F.lit(" Che dice l'art. "), (F.col("conv_id") % 50 + 1).cast("string"), F.lit(" della legge 241/1990?"))
    turns = t("conversations").withColumn("text", F.when(F.col("role") == "user", asked).otherwise(F.col("text")))
    hybrid = turns.where("role = 'user'").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 7 % 30 + 60).cast("string").alias("id"), F.lit(1).alias("rank")).distinct()
    return pl.answer_context(turns, chunks, hybrid, 5, 6000)

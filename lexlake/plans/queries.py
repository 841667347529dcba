"""Every operator as a query over the tables of a directory, each with the same thing in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import ingestion as ing
from ..operators import inverted as iv
from ..operators import parsing as pr
from ..operators import reranking as rr
from ..operators import retrieval as rt
from ..sources.scratch import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers f(tables) under its name; whole numbers come out as 64 bits, as SQL counts do."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.select(*(F.col(c.name).cast("long").alias(c.name) if isinstance(c.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(c.name) for c in df.schema))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Retrieval. The query set: every row whose id is divisible by 100, against all rows.

_POST = r"""d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
q AS (SELECT DISTINCT doc_id AS query_id, term FROM post WHERE doc_id % 100 = 0)"""
_BM25 = """s AS (SELECT query_id, o.doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
FROM {post} o JOIN q USING (term) JOIN df USING (term), n GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k})"""
_COS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings {where}),
c AS (SELECT a.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(v.e, a.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(a.e, a.e))), 6) AS score FROM v, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) a),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= {k})"""


def _index(docs: DataFrame, analyse: Callable[[str], str | None] | None = None) -> DataFrame:
    """A stored inverted index of documents, in the folder that all machines share."""
    folder = shared_folder(docs.sparkSession)
    iv.write_index(iv.blocks(docs, "doc_id", "text", analyse), folder, 8)
    return iv.read_index(docs.sparkSession, folder)


def _bm25(t: Tables, k: int, keep=None) -> DataFrame:
    docs = t("documents")
    asked = iv.asked_terms(docs.where("doc_id % 100 = 0"), "doc_id", "text")
    if keep is None:
        return iv.search(_index(docs), asked, k)
    return iv.search(_index(docs.where(keep)), asked, k, rt.corpus_size(docs, "text"))


def _cosine(t: Tables, k: int, among: DataFrame | None = None) -> DataFrame:
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return rt.cosine_topk(e if among is None else e.join(among, "id", "left_semi"), asked, k)


@query(f"WITH {_POST}, df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), {_BM25.format(post='post', k=10)} SELECT query_id, id, score, rank FROM b")
def bm25_topk(t: Tables) -> DataFrame:
    """RET-02, AGG-20, JON-13: whole texts as queries, against a stored inverted index."""
    return _bm25(t, 10)


@query(f"WITH {_COS.format(where='', k=10)} SELECT query_id, id, score, rank FROM dn")
def dense_topk(t: Tables) -> DataFrame:
    """RET-01, JON-12, SCL-21."""
    return _cosine(t, 10)


_HYBRID = f"""WITH {_POST}, en AS (SELECT o.* FROM post o JOIN d ON d.doc_id = o.doc_id WHERE d.lang = 'en'),
df AS (SELECT term, count(*) AS df FROM en GROUP BY 1), {_BM25.format(post='en', k=50)},
{_COS.format(where="WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", k=50)},
u AS (SELECT query_id, id, rank FROM b UNION ALL SELECT query_id, id, rank FROM dn),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""


@query(_HYBRID)
def hybrid_search(t: Tables) -> DataFrame:
    """RET-01/02/03, FLT-02, TOP-04: both branches keep English documents before their best 50; documents and vectors are paired by id."""
    english = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return rt.rank_fusion([_bm25(t, 50, F.col("lang") == "en"), _cosine(t, 50, english)], 10)


@query(f"""WITH {_COS.format(where='', k=50)}, r AS (SELECT query_id, id, rank AS upstream_rank, (id * 7 + query_id) % 13 AS score FROM dn)
SELECT query_id, id, score, upstream_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, upstream_rank) AS rank FROM r) WHERE rank <= 10""")
def rerank_stable(t: Tables) -> DataFrame:
    """TOP-05, RET-05: pairs through a stand-in scorer, in batches of any queries; equal scores keep the upstream order."""
    scorer = lambda pairs: [(int(text) * 7 + int(asked)) % 13 for asked, text in pairs]
    hits = _cosine(t, 50).withColumns({"asked": F.col("query_id").cast("string"), "text": F.col("id").cast("string")})
    return rr.rerank_pairs(hits, "asked", "text", scorer, 10).select("query_id", "id", F.col("score").cast("long").alias("score"), "upstream_rank", "rank")


@query("""WITH x AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_linenumber AS rank, 0 AS tier FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 1 FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 2 FROM lineitem),
m AS (SELECT query_id, id, min((tier, rank)) AS a FROM x GROUP BY 1, 2),
f AS (SELECT query_id, id, a[1] AS tier, a[2] AS tier_rank FROM m)
SELECT query_id, id, tier::BIGINT AS tier, tier_rank::BIGINT AS tier_rank, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, tier_rank, id) AS position FROM f) WHERE position <= 4""")
def merge_tiers_cap(t: Tables) -> DataFrame:
    """SET-01, SET-07, TOP-06, WIN-10: the lines of an order as a query's hits in three tiers."""
    x = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"), "l_returnflag", "l_linestatus")
    return rt.merge_tiers([x.where("l_returnflag = 'R'"), x.where("l_linestatus = 'O'"), x], 4)


@query("""SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1""")
def sources_dedup(t: Tables) -> DataFrame:
    """SET-02/03/04, JON-11: the first hit of each (act, article)."""
    return rt.first_of(t("documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")])


@query("""SELECT source, doc_id, cost, spent FROM (SELECT source, doc_id, greatest(1, n_chars // 4)::BIGINT AS cost, sum(greatest(1, n_chars // 4)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM documents) WHERE spent <= 6000""")
def token_budget(t: Tables) -> DataFrame:
    """WIN-05, SCL-10."""
    docs = t("documents").select("source", "doc_id", "n_chars")
    return rt.within_budget(docs, ["source"], [F.asc("doc_id")], F.col("n_chars"), 6000).select("source", "doc_id", "cost", "spent")


@query("""WITH r AS (SELECT l_orderkey AS hit_id, l_linenumber AS pos, l_partkey AS target FROM lineitem), h AS (SELECT hit_id, target, min(pos) AS pos FROM r GROUP BY 1, 2)
SELECT target, count(*) AS n, min(pos)::BIGINT AS first_pos FROM h WHERE target NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1""")
def citation_frequency(t: Tables) -> DataFrame:
    """AGG-09, JON-06: order lines as citations of parts."""
    refs = t("lineitem").select(F.col("l_orderkey").alias("hit_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("target"))
    return rt.citation_frequency(refs, t("part").where("p_size <= 10").select(F.col("p_partkey").alias("target")))


@query("""WITH h AS (SELECT l_orderkey AS act, l_linenumber AS article, list_distinct(list(l_suppkey % 5)) AS p FROM lineitem GROUP BY 1, 2),
m AS (SELECT o_orderkey * 10 + k AS marker, o_orderkey + (o_orderkey % 7 = 0)::INT * 100000000 AS act, CASE WHEN k = 0 THEN NULL ELSE k END AS article, CASE WHEN k = 2 THEN o_orderkey % 5 END AS paragraph FROM orders, (SELECT unnest(range(0, 9)) AS k)),
g AS (SELECT m.*, a.act IS NOT NULL AS has_act, h.act IS NOT NULL AS has_article, p FROM m LEFT JOIN (SELECT DISTINCT act FROM h) a ON a.act = m.act LEFT JOIN h ON h.act = m.act AND h.article = m.article),
r AS (SELECT marker, act, article, paragraph, CASE WHEN NOT has_act THEN 'unknown_act' WHEN article IS NOT NULL AND NOT has_article THEN 'unknown_article' WHEN paragraph IS NOT NULL AND NOT coalesce(list_contains(p, paragraph), false) THEN 'unknown_paragraph' ELSE 'ok' END AS reason FROM g)
SELECT *, reason IN ('ok', 'unknown_paragraph') AS verified FROM r""")
def guardrail_verdict(t: Tables) -> DataFrame:
    """JON-07, RET-10: markers made of order keys, checked against the orders' lines."""
    hits = t("lineitem").select(F.col("l_orderkey").alias("act"), F.col("l_linenumber").cast("long").alias("article"), F.array(F.col("l_suppkey") % 5).alias("paragraphs"))
    k = t("orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    act = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 0, 100000000).otherwise(0)
    markers = k.select((F.col("o_orderkey") * 10 + F.col("k")).alias("marker"), act.alias("act"), F.when(F.col("k") > 0, F.col("k").cast("long")).alias("article"), F.when(F.col("k") == 2, F.col("o_orderkey") % 5).alias("paragraph"))
    return rt.guardrail(markers, hits)


_EVAL = """{cos}, h AS (SELECT dn.query_id, dn.rank, l1.label = l2.label AS hit, l1.label FROM dn JOIN embeddings l1 ON l1.vec_id = dn.query_id JOIN embeddings l2 ON l2.vec_id = dn.id WHERE dn.id <> dn.query_id),
g AS (SELECT query_id, label AS kind, min(rank) FILTER (hit) AS fr FROM h GROUP BY 1, 2)"""
_METRICS = "count(*) AS n, round(avg(CASE WHEN fr <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN fr <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1 / fr, 0.0)), 6) AS mrr"


def _ranks(t: Tables, hits: DataFrame) -> DataFrame:
    labels = t("embeddings").select(F.col("vec_id"), "label")
    q, d = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("kind")), labels.select(F.col("vec_id").alias("id"), "label")
    known = hits.where("id <> query_id").join(q, "query_id").join(d, "id")
    return rt.first_hit_rank(known, F.col("kind") == F.col("label")).join(q, "query_id")


@query(f"WITH {_EVAL.format(cos=_COS.format(where='', k=10))} SELECT kind::BIGINT AS kind, {_METRICS} FROM g GROUP BY ROLLUP (kind)")
def eval_by_kind(t: Tables) -> DataFrame:
    """AGG-03/04, JON-08, WIN-04, RET-11: a hit is relevant if it has the query's label; kind null is overall."""
    return rt.quality(_ranks(t, _cosine(t, 10)), "kind")


@query(f"""WITH {_EVAL.format(cos=_COS.format(where='', k=10))}, g2 AS (SELECT query_id, kind, CASE WHEN query_id % 3 = 0 THEN fr + 2 ELSE fr END AS fr FROM g),
a AS (SELECT kind, {_METRICS} FROM g GROUP BY 1), b AS (SELECT kind, {_METRICS} FROM g2 GROUP BY 1)
SELECT a.kind::BIGINT AS kind, round(b.recall_5 - a.recall_5, 6) AS d_recall_5, round(b.mrr - a.mrr, 6) AS d_mrr, b.recall_5 - a.recall_5 >= 0.03 AS adopt FROM a JOIN b ON a.kind = b.kind""")
def eval_comparison(t: Tables) -> DataFrame:
    """AGG-06, JON-09: a changed ranking against the baseline; adopted from three points of recall on."""
    base = _ranks(t, _cosine(t, 10))
    other = base.withColumn("first_rank", F.when(F.col("query_id") % 3 == 0, F.col("first_rank") + 2).otherwise(F.col("first_rank")))
    a, b = (rt.quality(x, "kind").where("kind is not null") for x in (base, other))
    b = b.select("kind", F.col("recall_5").alias("b5"), F.col("mrr").alias("bm"))
    gain = F.col("b5") - F.col("recall_5")
    return a.join(b, "kind").select("kind", F.round(gain, 6).alias("d_recall_5"), F.round(F.col("bm") - F.col("mrr"), 6).alias("d_mrr"), (gain >= 0.03).alias("adopt"))


# Ingestion. A document is a file source/doc_id.md; its identity is its text in lower case and single spaces.

_FILES = r"f AS (SELECT doc_id, source, n_chars, text, concat(source, '/', doc_id::VARCHAR, '.md') AS path, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key, CASE WHEN doc_id % 9 = 0 THEN 'abrogato' WHEN doc_id % 17 = 0 THEN 'decaduto' ELSE 'vigente' END AS status FROM documents)"


def _files(t: Tables) -> DataFrame:
    status = F.when(F.col("doc_id") % 9 == 0, "abrogato").when(F.col("doc_id") % 17 == 0, "decaduto").otherwise("vigente")
    return t("documents").select("doc_id", "source", "n_chars", "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).alias("key"), status.alias("status"))


@query(f"WITH {_FILES} SELECT path, key, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) = 1 AS owner FROM f")
def first_file_wins(t: Tables) -> DataFrame:
    """WIN-01, SET-08, JON-02."""
    return ing.first_file_wins(_files(t), "key", [F.asc("source"), F.asc("doc_id")]).select("path", "key", "owner")


@query(f"WITH {_FILES} SELECT key, coalesce(max_by(status, doc_id) FILTER (status <> 'vigente'), 'vigente') AS status FROM f GROUP BY 1")
def status_override(t: Tables) -> DataFrame:
    """WIN-02."""
    return ing.status_override(_files(t), "key", "status", F.col("doc_id"))


@query(f"WITH {_FILES} SELECT path, md5(text) AS sha FROM f WHERE NOT (doc_id % 3 = 0)")
def resume_skip(t: Tables) -> DataFrame:
    """FLT-05, JON-01: a third of the files is recorded with its hash, some others with an old one."""
    files = _files(t).select("doc_id", "path", F.md5("text").alias("sha"))
    done = files.where("doc_id % 3 = 0").select("path", "sha").union(files.where("doc_id % 3 = 1").select("path", F.lit("old")))
    return ing.resume_skip(files, done, "path", "sha").select("path", "sha")


@query("SELECT doc_id, sha1(concat('blob ', octet_length(encode(text))::VARCHAR, chr(0), text)) AS sha FROM documents")
def blob_sha(t: Tables) -> DataFrame:
    """SCL-01."""
    return t("documents").select("doc_id", tx.blob_sha(F.col("text")).alias("sha"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n_chunks FROM lineitem GROUP BY 1) SELECT l_orderkey, n_chunks, ((sum(n_chunks) OVER (ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) - 1) // 256)::BIGINT AS durable_lot FROM c""")
def lot_durability(t: Tables) -> DataFrame:
    """ING-02: the lines of an order as a file's chunks."""
    return ing.lot_durability(t("lineitem").select("l_orderkey", F.col("l_orderkey").alias("o")), "l_orderkey", [F.col("o")])


@query(f"""WITH {_FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) = 1 AS owner FROM f),
g AS (SELECT source, count(*) AS files, count(*) FILTER (NOT owner) AS skipped, sum(CASE WHEN owner THEN n_chars ELSE 0 END)::BIGINT AS chars FROM o GROUP BY ROLLUP (source)) SELECT *, round_even(chars / 2.26, 0)::BIGINT AS est_tokens FROM g""")
def dry_run_estimate(t: Tables) -> DataFrame:
    """AGG-02, ING-09, SCL-10."""
    return ing.dry_run(_files(t), "source", "key", [F.asc("source"), F.asc("doc_id")], F.col("n_chars"))


_SNAP = f"""{_FILES}, o AS (SELECT path, md5(text) AS sha FROM f WHERE doc_id % 10 <> 0),
n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN concat('moved/', path) ELSE path END AS path, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS sha FROM f WHERE doc_id % 7 <> 0),
x AS (SELECT coalesce(o.path, n.path) AS path, o.sha AS os, n.sha AS ns FROM o FULL JOIN n ON o.path = n.path),
gone AS (SELECT path AS old_path, os AS sha, row_number() OVER (PARTITION BY os ORDER BY path) AS k FROM x WHERE ns IS NULL),
come AS (SELECT path, ns AS sha, row_number() OVER (PARTITION BY ns ORDER BY path) AS k FROM x WHERE os IS NULL),
ch AS (SELECT CASE WHEN old_path IS NOT NULL AND path IS NOT NULL THEN 'move' WHEN path IS NULL THEN 'delete' ELSE 'upsert' END AS status, coalesce(path, old_path) AS path, CASE WHEN path IS NOT NULL THEN old_path END AS old_path FROM gone FULL JOIN come ON gone.sha = come.sha AND gone.k = come.k
UNION ALL SELECT 'upsert', path, NULL FROM x WHERE os <> ns)"""


def _changes(t: Tables) -> DataFrame:
    f = _files(t)
    old = f.where("doc_id % 10 <> 0").select("path", F.md5("text").alias("sha"))
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return ing.snapshot_diff(old, f.where("doc_id % 7 <> 0").select(path.alias("path"), F.md5(text).alias("sha")))


@query(f"WITH {_SNAP} SELECT status, path, old_path FROM ch")
def snapshot_diff(t: Tables) -> DataFrame:
    """SRC-05."""
    return _changes(t)


@query(f"""WITH {_SNAP}, c AS (SELECT coalesce(old_path, path) AS p, status AS change, path AS np FROM ch WHERE status <> 'upsert')
SELECT doc_id AS key, CASE WHEN change = 'delete' AND f.status = 'vigente' THEN 'abrogato' ELSE f.status END AS status, CASE WHEN change = 'delete' THEN NULL WHEN change = 'move' THEN np ELSE f.path END AS path FROM f LEFT JOIN c ON c.p = f.path WHERE doc_id % 10 <> 0""")
def delta_apply(t: Tables) -> DataFrame:
    """ING-03/04/05, JON-03, SNK-03/06."""
    acts = _files(t).where("doc_id % 10 <> 0").select(F.col("doc_id").alias("key"), "status", "path")
    return ing.apply_changes(acts, _changes(t))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45)""")
def stale_points(t: Tables) -> DataFrame:
    """SET-05, SNK-04, JON-10: lines of more than 45 were produced again."""
    old = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ing.stale_points(old, old.where("l_quantity > 45"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 'X', NULL FROM orders WHERE o_orderkey % 40 = 0 AND o_orderkey > 0""")
def latest_wins_upsert(t: Tables) -> DataFrame:
    """SNK-02/05/07: omitted values become null."""
    base = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = base.where("o_orderkey % 4 = 0").select("o_orderkey").union(base.where("o_orderkey % 40 = 0 and o_orderkey > 0").select(-F.col("o_orderkey")))
    return ing.latest_wins(base, new.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice")), ["o_orderkey"])


@query("""SELECT max_by(commit_to, id) AS commit_to, max(id) AS run_id FROM (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN user_id % 3 > 0 THEN md5(event_id::VARCHAR) END AS commit_to FROM events) WHERE status = 'completed' AND commit_to IS NOT NULL""")
def run_watermark(t: Tables) -> DataFrame:
    """FLT-07, ING-07, SNK-09: events as runs."""
    runs = t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.when(F.col("user_id") % 3 > 0, F.md5(F.col("event_id").cast("string"))).alias("commit_to"))
    return ing.watermark(runs)


# Parsing. Headings, markers and numbers are put into the documents' lines by a rule on the line number.

_MARKS = """CASE WHEN line_no % 13 = 2 THEN concat('### Art. ', cast(line_no AS string)) WHEN line_no % 13 = 4 THEN concat('CAPO ', cast(line_no AS string)) WHEN line_no % 13 = 5 THEN '-----'
WHEN line_no % 13 = 7 THEN '' WHEN line_no % 13 = 8 THEN '====' WHEN line_no % 13 = 9 THEN concat('Art. ', cast(line_no AS string), '-bis') WHEN line_no % 13 = 10 THEN '---' WHEN line_no % 13 = 12 THEN concat('ANNEX-art. ', cast(line_no AS string)) ELSE line END"""
_NUMBERED = "CASE WHEN line_no % 4 = 0 THEN concat(cast((length(line) * 7) % 23 AS string), '. ', line) WHEN line_no % 9 = 5 THEN concat(cast(length(line) % 23 AS string), '-ter. ', line) WHEN line_no % 9 = 3 THEN concat('(', substr(line, 1, 9), ')') ELSE line END"
_LINES = "l0 AS (SELECT doc_id AS doc, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), l AS (SELECT doc, line_no, {rule} AS line FROM l0)"


def _lines(t: Tables, rule: str) -> DataFrame:
    return pr.lines(t("documents"), "doc_id", "text").withColumn("line", F.expr(rule))


_EVENTS = _LINES.format(rule=_MARKS) + r""", k AS (SELECT *, CASE WHEN trim(regexp_replace(line, '\s+', ' ', 'g')) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'atx' WHEN regexp_matches(line, '^=+\s*$') THEN 'h1' WHEN regexp_matches(line, '^-{2,}\s*$') THEN 'h2' ELSE 'line' END AS kind FROM l),
k2 AS (SELECT *, sum((kind <> 'line')::INT) OVER (PARTITION BY doc ORDER BY line_no) AS block FROM k),
k3 AS (SELECT *, first_value(CASE WHEN kind <> 'line' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nk FROM k2),
e AS (SELECT doc, max(line_no) + 1 AS line_no, nk AS kind, string_agg(trim(line), ' ' ORDER BY line_no) AS payload FROM k3 WHERE kind = 'line' AND nk IN ('h1', 'h2') GROUP BY doc, block, nk
UNION ALL SELECT doc, line_no, kind, CASE kind WHEN 'blank' THEN '' WHEN 'atx' THEN trim(line) ELSE line END FROM k3 WHERE kind IN ('blank', 'atx') OR (kind = 'line' AND coalesce(nk NOT IN ('h1', 'h2'), true)))"""


@query(f"WITH {_EVENTS} SELECT doc, line_no, kind, payload FROM e")
def line_tokenizer(t: Tables) -> DataFrame:
    """PRS-01."""
    return pr.line_events(_lines(t, _MARKS))


@query("WITH " + _EVENTS + r""", a AS (SELECT *, CASE WHEN kind = 'atx' AND regexp_matches(payload, '^###\s+Art\.?\s*\d+') THEN regexp_extract(payload, '(\d+)', 1) WHEN kind = 'h2' AND regexp_matches(payload, '^Art\.?\s+\d+(?:-bis)?\.?\s*$') THEN regexp_extract(payload, '(\d+(?:-bis)?)', 1)
WHEN kind = 'line' AND regexp_matches(payload, '^\S.*?-art\.\s+\d+\s*$') THEN regexp_extract(payload, '(\d+)\s*$', 1) END AS number FROM e),
b AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN true WHEN kind IN ('h1', 'h2', 'atx') THEN false END IGNORE NULLS) OVER w AS inside, sum((number IS NOT NULL)::INT) OVER w AS article_no,
last_value(CASE WHEN kind = 'h2' AND number IS NULL AND regexp_matches(payload, '(?i)^(LIBRO|PARTE|TITOLO|CAPO|SEZIONE)\b') THEN payload END IGNORE NULLS) OVER w AS part FROM a WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
g AS (SELECT doc, article_no::BIGINT AS article_no, max(number) AS number, max(CASE WHEN number IS NULL THEN NULL WHEN kind = 'line' THEN 'plain' WHEN kind = 'h2' THEN 'setext' ELSE kind END) AS style, max(part) FILTER (number IS NOT NULL) AS part, max(regexp_extract(payload, '^(\S.*?)-art', 1)) FILTER (number IS NOT NULL AND kind = 'line') AS annex,
coalesce(string_agg(payload, chr(10) ORDER BY line_no) FILTER (number IS NULL), '') AS body FROM b WHERE inside GROUP BY doc, article_no)
SELECT doc, article_no, number, style, concat_ws(' — ', part, annex) AS path, body FROM g
UNION ALL SELECT doc, 1, 'unico', 'none', '', coalesce(string_agg(payload, chr(10) ORDER BY line_no) FILTER (kind = 'line'), '') FROM e WHERE doc NOT IN (SELECT doc FROM g) GROUP BY doc""")
def article_assignment(t: Tables) -> DataFrame:
    """PRS-02/03/12."""
    return pr.articles(pr.line_events(_lines(t, _MARKS)))


@query("WITH " + _LINES.format(rule=_NUMBERED) + r""", k AS (SELECT *, regexp_extract(line, '^(\d+)(-ter)?\.\s', 1) AS b, regexp_extract(line, '^(\d+)(-ter)?\.\s', 2) AS s FROM l),
k2 AS (SELECT *, CASE WHEN b <> '' THEN b::BIGINT * 100 + CASE WHEN s = '' THEN 0 ELSE 2 END END AS key FROM k),
k3 AS (SELECT *, coalesce(key > coalesce(max(key) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), false) AS opens FROM k2),
k4 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY line_no) AS paragraph_no FROM k3)
SELECT doc, paragraph_no::BIGINT AS paragraph_no, max(concat(b, s)) FILTER (opens) AS number, min(line_no) AS first_line, count(*) AS n_lines FROM k4 GROUP BY 1, 2""")
def comma_scan(t: Tables) -> DataFrame:
    """PRS-07/08."""
    return pr.paragraphs(_lines(t, _NUMBERED))


@query("WITH " + _LINES.format(rule=_NUMBERED) + r""", k AS (SELECT doc, line_no, trim(line) AS x FROM l WHERE trim(line) <> ''), k2 AS (SELECT *, row_number() OVER w AS place, max(regexp_matches(x, '^\d+(-ter)?\.\s')::INT) OVER w AS numbered FROM k WINDOW w AS (PARTITION BY doc ORDER BY line_no))
SELECT doc, arg_min(regexp_extract(x, '^\((.+?)\)\.?$', 1), place) AS rubric FROM k2 WHERE place <= 4 AND numbered = 0 AND regexp_matches(x, '^\([^(].*?\)\.?$') GROUP BY 1""")
def rubric_extract(t: Tables) -> DataFrame:
    """PRS-06 over whole documents; the removal from the body is in article_finish."""
    return pr.rubrics(_lines(t, _NUMBERED))


@query()
def article_finish(t: Tables) -> DataFrame:
    """PRS-04/05/06/09."""
    return pr.article_paragraphs(pr.finish_articles(pr.articles(pr.line_events(_lines(t, _MARKS)))))


# Chunks.


@query("WITH " + _LINES.format(rule="line") + r""", k AS (SELECT doc, count(*) AS n_paragraphs, (sum(length(trim(line))) + greatest(0, 2 * (count(*) FILTER (length(trim(line)) > 0) - 1)))::BIGINT AS body_len FROM l GROUP BY 1) SELECT *, n_paragraphs > 25 OR body_len > 6000 AS split FROM k""")
def chunk_split_flag(t: Tables) -> DataFrame:
    """CHK-01."""
    return ch.split_flag(_lines(t, "line"), "doc", F.col("line"))


@query("WITH RECURSIVE " + _LINES.format(rule="line") + """, s AS MATERIALIZED (SELECT doc, line_no, length(line) AS n FROM l), r AS (SELECT doc, line_no, n AS size, 0 AS g FROM s WHERE line_no = 1
UNION ALL SELECT s.doc, s.line_no, CASE WHEN r.size + 1 + s.n <= 1500 THEN r.size + 1 + s.n ELSE s.n END, CASE WHEN r.size + 1 + s.n <= 1500 THEN r.g ELSE r.g + 1 END FROM r JOIN s ON s.doc = r.doc AND s.line_no = r.line_no + 1)
SELECT doc, g::BIGINT AS group_no, count(*) AS n_lines, min(line_no) AS first_line FROM r GROUP BY 1, 2""")
def chunk_greedy_groups(t: Tables) -> DataFrame:
    """CHK-03: a fold over each document's line lengths."""
    sized = t("documents").select(F.col("doc_id").alias("doc"), F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("sizes"))
    each = sized.select("doc", F.posexplode(ch.grouped(F.col("sizes"), 1500)).alias("at", "group_no"))
    return each.groupBy("doc", "group_no").agg(F.count("*").alias("n_lines"), (F.min("at") + 1).alias("first_line"))


@query("WITH RECURSIVE " + _LINES.format(rule="line") + """, s AS MATERIALIZED (SELECT doc, line_no, length(line) AS n, sum(length(line) + 2) OVER (PARTITION BY doc ORDER BY line_no) AS upto, max(line_no) OVER (PARTITION BY doc) AS lines FROM l),
e AS (SELECT a.doc, a.line_no AS start, greatest(max(CASE WHEN b.upto - (a.upto - a.n - 2) - 2 <= 4500 THEN b.line_no END), a.line_no, max(CASE WHEN b.line_no = a.line_no + 1 AND a.n + 2 + b.n <= 7600 THEN b.line_no END)) AS last FROM s a JOIN s b ON b.doc = a.doc AND b.line_no >= a.line_no AND (b.upto - (a.upto - a.n - 2) - 2 <= 7600 OR b.line_no <= a.line_no + 1) GROUP BY a.doc, a.line_no, a.n),
nx AS MATERIALIZED (SELECT e.doc, start, last, CASE WHEN last = p.lines THEN NULL WHEN p.n + 2 + q.n <= 7600 THEN last ELSE last + 1 END AS next FROM e JOIN s p ON p.doc = e.doc AND p.line_no = e.last LEFT JOIN s q ON q.doc = e.doc AND q.line_no = e.last + 1),
r AS (SELECT doc, start, last, next, 0 AS g FROM nx WHERE start = 1 UNION ALL SELECT nx.doc, nx.start, nx.last, nx.next, g + 1 FROM r JOIN nx ON nx.doc = r.doc AND nx.start = r.next)
SELECT doc, g::BIGINT AS group_no, start::BIGINT AS first_segment, last::BIGINT AS last_segment, (last - start + 1)::BIGINT AS n_segments FROM r""")
def chunk_overlap_groups(t: Tables) -> DataFrame:
    """CHK-04: ranges with an overlap of one segment."""
    return ch.group_segments(_lines(t, "line").select("doc", "line_no", F.length("line").alias("size")), "doc", "line_no", "size")


def _trunc_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(rtrim(CASE WHEN contains(substr({x}, 1, {n - 1}), ' ') THEN regexp_extract(substr({x}, 1, {n - 1}), '(?s)^(.*) [^ ]*$', 1) ELSE substr({x}, 1, {n - 1}) END), '…') END"


def _header_sql(t: int, r: int, p: int) -> str:
    return f"concat(concat('Legge ', doc_id::VARCHAR, '/', (2000 + doc_id % 20)::VARCHAR), ' — ', {_trunc_sql('title', t)}, chr(10), {_trunc_sql('path', p)}, chr(10), 'Art. ', (doc_id % 50)::VARCHAR, ' — ', {_trunc_sql('rubric', r)}, ' (comma 1)')"


@query(f"""WITH x AS (SELECT doc_id, replace(text, chr(10), ' ') AS title, replace(concat(source, ' ', text), chr(10), ' ') AS rubric, replace(concat(lang, ' ', text), chr(10), ' ') AS path FROM documents),
h AS (SELECT doc_id, {", ".join(f"{_header_sql(*b)} AS h{k}" for k, b in enumerate(ch.BUDGETS))} FROM x)
SELECT doc_id, CASE WHEN length(h0) <= 300 THEN h0 WHEN length(h1) <= 300 THEN h1 WHEN length(h2) <= 300 THEN h2 WHEN length(h3) <= 300 THEN h3 ELSE substr(h3, 1, 300) END AS header FROM h""")
def chunk_header(t: Tables) -> DataFrame:
    """CHK-06/07/10."""
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    marker = ch.range_marker(F.array(F.lit("1")), F.lit(0), F.lit(2))
    h = ch.chunk_header(F.lit("Legge"), F.col("doc_id").cast("string"), 2000 + F.col("doc_id") % 20, flat(F.col("text")), flat(F.concat_ws(" ", "lang", "text")), (F.col("doc_id") % 50).cast("string"), flat(F.concat_ws(" ", "source", "text")), marker)
    return t("documents").select("doc_id", h.alias("header"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 AS number, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey) AS occ FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, occ, concat(l_orderkey::VARCHAR, '#art-', number::VARCHAR, CASE WHEN occ > 1 THEN concat('.', occ::VARCHAR) ELSE '' END, '#0') AS chunk_id FROM x""")
def occurrence_ids(t: Tables) -> DataFrame:
    """WIN-03, CHK-05."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 3).alias("number"))
    return ch.occurrence_ids(x, "l_orderkey", "number", [F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_linenumber", "occ", "chunk_id")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)""")
def act_window(t: Tables) -> DataFrame:
    """WIN-08, JON-14."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ch.neighbours(x, "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey")], "l_partkey").select("l_orderkey", "l_linenumber", "before", "after")


_ARTICLE = "CASE WHEN p_partkey % 7 = 0 THEN concat('all-', cast(p_size AS string)) WHEN p_partkey % 3 = 0 THEN concat(cast(p_size AS string), '-bis') WHEN p_partkey % 5 = 0 THEN concat(cast(p_size AS string), '-ter') ELSE cast(p_size AS string) END"


@query(f"""WITH x AS (SELECT p_brand, p_partkey, {_ARTICLE} AS article FROM part),
y AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (regexp_extract(article, '^(\\d+)', 1) = ''), TRY_CAST(regexp_extract(article, '^(\\d+)', 1) AS BIGINT) NULLS FIRST, CASE WHEN article LIKE '%-bis' THEN 1 WHEN article LIKE '%-ter' THEN 2 ELSE 0 END, article, p_partkey) AS rank FROM x) SELECT p_brand, p_partkey, article, rank FROM y WHERE rank <= 5""")
def legal_order(t: Tables) -> DataFrame:
    """TOP-01: the first five of each act."""
    x = t("part").select("p_brand", "p_partkey", F.expr(_ARTICLE).alias("article"))
    return rt.top_per(x, ["p_brand"], [*ch.legal_order(F.col("article")), F.asc("p_partkey")], 5)


@query("""SELECT l_orderkey, l_partkey, rank FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE rank <= 3""")
def article_caps(t: Tables) -> DataFrame:
    """TOP-03, JON-04/05, FLT-03, RET-08."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return rt.top_per(x, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey")], 3).select("l_orderkey", "l_partkey", "rank")

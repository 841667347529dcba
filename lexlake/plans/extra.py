"""Queries of requests, configuration, census reports, chunks from end to end, runs, streams and small scalars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dims import COLLECTION_TYPE
from ..operators import bootstrap as bs
from ..operators import chunking as ch
from ..operators import identity as idn
from ..operators import ingestion as ing
from ..operators import parsing as pr
from ..operators import pipeline as pl
from ..operators import reports as rp
from ..operators import validation as va
from ..sources import html
from ..sources.lots import in_lots
from ..streaming import admission, events, markers
from .queries import _FILES, _LINES, _MARKS, Tables, _files, _lines, query


def text_of(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# Pages. Documents as acts in the form of captured HTML; signs of markup are taken out of their words.

_PLAIN = "translate(text, '<>&', '   ')"
_PAGE = f"""concat('<h1 class="x tipo-numero-data-akn">LEGGE n. ', cast(doc_id AS string), '</h1><h2 class="titolo-atto-akn">Di prova</h2><h2 class="article-num-akn">Art. ', cast(doc_id % 50 AS string), ' bis</h2><span class="art-just-text-akn">', {_PLAIN}, '</span><div class="attachment-name">ANNEX-art. 7</div><span class="attachment-just-text">uno<br>due <span>tre</span></span>')"""


@query(rf"""WITH x AS (SELECT doc_id, list_transform(string_split({_PLAIN}, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS x FROM documents)
SELECT doc_id AS id, concat('LEGGE n. ', doc_id::VARCHAR) AS title, 'Di prova' AS subtitle, 0::BIGINT AS pos, concat((doc_id % 50)::VARCHAR, '-bis') AS number, NULL::VARCHAR AS annex, regexp_replace(array_to_string(x, chr(10)), '^\s+|\s+$', '', 'g') AS text, NULL::VARCHAR AS warning FROM x
UNION ALL SELECT doc_id, concat('LEGGE n. ', doc_id::VARCHAR), 'Di prova', 1, '7', 'ANNEX', concat('uno', chr(10), 'due tre'), NULL FROM documents""")
def html_articles(t: Tables) -> DataFrame:
    """PRS-10/11: title, subtitle, an article and an attachment of each page."""
    return html.html_articles(t("documents").select("doc_id", F.expr(_PAGE).alias("html")), "doc_id", "html")


# Chunks.


@query("WITH RECURSIVE " + _LINES.format(rule="line") + """, u AS (SELECT doc, line_no, line, unnest(range(0, CASE WHEN length(line) > 7600 THEN (length(line) + 4499) // 4500 ELSE 1 END)) AS k FROM l WHERE doc IN (SELECT doc_id FROM documents WHERE length(text) > 7600)),
c AS (SELECT doc, line_no, k, CASE WHEN length(line) > 7600 THEN substr(line, k * 4500 + 1, 4500) ELSE line END AS line FROM u), s AS MATERIALIZED (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line_no, k) AS line_no, line, length(line) AS n FROM c), r AS (SELECT doc, line_no, n AS size, 0 AS g FROM s WHERE line_no = 1
UNION ALL SELECT s.doc, s.line_no, CASE WHEN r.size + 1 + s.n <= 4500 THEN r.size + 1 + s.n ELSE s.n END, CASE WHEN r.size + 1 + s.n <= 4500 THEN r.g ELSE r.g + 1 END FROM r JOIN s ON s.doc = r.doc AND s.line_no = r.line_no + 1),
p AS (SELECT r.doc, g, string_agg(line, chr(10) ORDER BY r.line_no) AS piece FROM r JOIN s ON s.doc = r.doc AND s.line_no = r.line_no GROUP BY 1, 2)
SELECT doc, g::BIGINT AS piece_no, length(piece)::BIGINT AS chars, md5(piece) AS md5 FROM p""")
def oversized_pieces(t: Tables) -> DataFrame:
    """CHK-02/03: texts above 7600 characters, which have lines but no blank ones, in pieces."""
    @F.arrow_udf("array<string>")
    def pieces(rows: pa.Array) -> pa.Array:
        return pa.array([ch.oversized_pieces(x or "") for x in rows.to_pylist()], pa.list_(pa.string()))

    long = t("documents").where(F.length("text") > ch.MOST_BODY)
    each = long.select(F.col("doc_id").alias("doc"), F.posexplode(pieces("text")).alias("piece_no", "piece"))
    return each.select("doc", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("md5"))


def act_files(t: Tables) -> DataFrame:
    """Documents as files of acts: a header, markers and numbers among their lines; some without header, some pages."""
    d = t("documents")
    marked = _lines(t, _MARKS).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x")).select("doc", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("marked"))
    head = F.concat(F.lit("LEGGE 7 agosto "), text_of(1900 + F.col("doc_id") % 120), F.lit(", n. "), text_of(F.col("doc_id") % 400), F.lit("\n====\n"))
    collection = F.when(F.col("doc_id") % 9 == 0, "Atti normativi abrogati (in originale)").when(F.col("doc_id") % 4 == 0, "DPR").otherwise(F.col("source"))
    text = F.when(F.col("doc_id") % 7 == 0, F.col("marked")).when(F.col("doc_id") % 11 == 0, F.base64(F.concat(F.lit("<html>"), F.expr(_PAGE)).cast("binary"))).otherwise(F.concat(head, F.col("marked")))
    full = d.join(marked, d.doc_id == marked.doc, "left").select(collection.alias("collection"), text_of("doc_id").alias("n"), text.alias("text"))
    return full.select(F.concat("collection", F.lit("/"), "n", F.lit(".md")).alias("path"), "collection", "text", tx.blob_sha(F.coalesce("text", F.lit(""))).alias("sha"))


@query(None)
def bootstrap_chunks(t: Tables) -> DataFrame:
    """ING-01, PRS-02/09/10/13, REF-01/10/11, JON-02, CHK-01..07/11/12, SET-06: chunks of all files."""
    files = act_files(t)
    return bs.bootstrap(files, files.select("path", "sha").where("false"))["chunks"]


@query(None)
def bootstrap_counts(t: Tables) -> DataFrame:
    """AGG-01, ING-01: outcomes by collection, of a run that finds some files done."""
    files = act_files(t)
    done = files.where(F.crc32("path") % 5 == 0).select("path", "sha")
    return bs.run_counts(bs.bootstrap(files, done)["files"], ["collection"])


# Requests and configuration.


@query("""WITH g AS (SELECT conv_id, count(*) AS n_turns, bool_and(coalesce(role IN ('user', 'assistant'), false)) AS roles, min(length(coalesce(text, ''))) AS least, max(length(coalesce(text, ''))) AS most, max_by(role, turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, n_turns, CASE WHEN n_turns > 20 THEN 'too_many_turns' WHEN NOT roles THEN 'unknown_role' WHEN least = 0 THEN 'empty_turn' WHEN most > 8000 THEN 'turn_too_long' WHEN last <> 'user' THEN 'last_turn_not_user' END AS reason FROM g""")
def turn_requests(t: Tables) -> DataFrame:
    """FLT-11."""
    return va.check_turns(t("conversations"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' ELSE text END AS q, doc_id % 28 AS k FROM documents)
SELECT doc_id, CASE WHEN trim(q) = '' THEN 'blank_query' WHEN length(q) > 2000 THEN 'query_too_long' WHEN k < 1 OR k > 25 THEN 'k_out_of_range' END AS reason FROM x""")
def search_requests(t: Tables) -> DataFrame:
    """FLT-11, RET-04."""
    q = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text"))
    return t("documents").select("doc_id", va.search_reason(q, F.col("doc_id") % 28).alias("reason"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 NOT IN (0, 1) THEN 'rating' WHEN length(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END) > 2000 THEN 'reason_too_long' WHEN length(source) = 0 THEN 'no_question' WHEN length(text) = 0 THEN 'no_answer' WHEN length(text) > 32000 THEN 'answer_too_long' WHEN doc_id % 130 > 100 THEN 'too_many_citations' END AS reason FROM documents""")
def feedback_requests(t: Tables) -> DataFrame:
    """FLT-11."""
    n = F.col("doc_id")
    rating = F.when(n % 5 == 0, 1).when(n % 5 == 1, -1).otherwise(0)
    return t("documents").select("doc_id", va.feedback_reason(rating, F.when(n % 3 == 0, F.col("text")), F.col("source"), F.col("text"), n % 130).alias("reason"))


_CATALOG = "SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'answer' ELSE 'query' END AS section, n_name AS model, lower(n_name) AS label, n_nationkey % 3 > 0 AS supports_effort, n_nationkey IN (0, 1) AS is_default FROM nation"
_CONFIGS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'answer' ELSE 'query' END AS section, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE n_name END AS model, CASE WHEN c_custkey % 3 > 0 THEN 'high' END AS effort FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query(f"""WITH k AS ({_CATALOG}), c AS ({_CONFIGS}), g AS (SELECT c.id, c.section, c.model AS asked, c.effort, k.label, k.supports_effort AS s, d.model AS dm, d.label AS dl, d.supports_effort AS ds FROM c LEFT JOIN k ON k.section = c.section AND k.model = c.model LEFT JOIN k d ON d.section = c.section AND d.is_default)
SELECT id, section, CASE WHEN label IS NOT NULL THEN asked ELSE dm END AS model, CASE WHEN CASE WHEN label IS NOT NULL THEN s ELSE ds END THEN effort END AS effort, coalesce(label, dl) AS label, CASE WHEN label IS NOT NULL AND asked <> dm THEN asked END AS normal_model,
concat(coalesce(label, dl), coalesce(concat(' · effort ', CASE WHEN CASE WHEN label IS NOT NULL THEN s ELSE ds END THEN effort END), CASE WHEN true THEN '' END), ' — QU: ', dl) AS summary FROM g""".replace("concat(' · effort ', CASE WHEN CASE WHEN label IS NOT NULL THEN s ELSE ds END THEN effort END)", "' · effort ' || CASE WHEN CASE WHEN label IS NOT NULL THEN s ELSE ds END THEN effort END"))
def effective_config(t: Tables) -> DataFrame:
    """JON-18, SCL-19, UI-07: nations as models, customers as configurations."""
    n = t("nation")
    catalog = n.select(F.when(F.col("n_regionkey") % 2 == 0, "answer").otherwise("query").alias("section"), F.col("n_name").alias("model"), F.lower("n_name").alias("label"), (F.col("n_nationkey") % 3 > 0).alias("supports_effort"), F.col("n_nationkey").isin(0, 1).alias("is_default"))
    c = t("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    section = F.when(F.col("c_custkey") % 2 == 0, "answer").otherwise("query")
    configs = c.select(F.col("c_custkey").alias("id"), section.alias("section"), F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(F.col("n_name")).alias("model"), F.when(F.col("c_custkey") % 3 > 0, "high").alias("effort"))
    default = catalog.where("is_default").select("section", F.col("label").alias("d"))
    got = va.effective_config(configs, catalog).join(default, "section")
    return got.withColumn("summary", va.config_summary(F.col("label"), F.col("effort"), F.col("d"), F.lit(None).cast("string"))).drop("d")


# Census. Markers are put into the documents' lines by a rule, names are made of ids.

_SCAN = _LINES.format(rule=_MARKS) + r""", p AS (SELECT *, lag(line) OVER w AS above, regexp_matches(line, '^(=+|-{2,})\s*$') AS under FROM l WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
h AS (SELECT doc, line_no, length(regexp_extract(line, '^(#{1,6}) ', 1)) AS level, regexp_extract(line, '^#{1,6} (.+?)\s*$', 1) AS text, false AS setext FROM p WHERE regexp_matches(line, '^#{1,6} .+')
UNION ALL SELECT doc, line_no, CASE WHEN starts_with(line, '=') THEN 1 ELSE 2 END, trim(regexp_replace(above, '\s+', ' ', 'g')), true FROM p WHERE under AND trim(coalesce(above, '')) <> '')"""


@query(f"WITH {_SCAN}, d AS (SELECT doc_id, source FROM documents) SELECT source, " + ", ".join(f"count(*) FILTER (setext AND level = {k}) AS s{k}" for k in (1, 2)) + ", " + ", ".join(f"count(*) FILTER (NOT setext AND level = {k}) AS a{k}" for k in range(1, 7)) + r""",
count(DISTINCT CASE WHEN NOT setext AND regexp_matches(text, '(?i)^Art\.?\s*\d+') THEN doc END) AS atx_files, count(DISTINCT CASE WHEN setext AND regexp_matches(text, '(?i)^Art\.?\s*\d+') THEN doc END) AS setext_files,
(SELECT count(DISTINCT doc) FROM l JOIN d d2 ON d2.doc_id = l.doc WHERE d2.source = d.source AND regexp_matches(line, '^\S.*-art\. \d+[a-z .]*$')) AS plain_files FROM d LEFT JOIN h ON h.doc = d.doc_id GROUP BY source""")
def census_headings(t: Tables) -> DataFrame:
    """PRS-14, AGG-10/11: headings by level, and files with each style of article marker, by collection."""
    scan = pr.census_scan(_lines(t, _MARKS)).join(t("documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    levels = ["s1", "s2", *(f"a{k}" for k in range(1, 7))]
    files = [F.count_if(F.col(f"{k}_art") > 0).alias(f"{k}_files") for k in ("atx", "setext", "plain")]
    return scan.groupBy("source").agg(*(F.sum(c).alias(c) for c in levels), *files)


@query(f"WITH {_SCAN}, k AS (SELECT upper(regexp_extract(text, '(?i)^(LIBRO|PARTE|TITOLO|CAPO|SEZIONE)\\b', 1)) AS keyword, doc, line_no, text FROM h), f AS (SELECT keyword, text, min((doc, line_no)) AS place FROM k WHERE keyword <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY place, text) AS k FROM f)" + """
SELECT keyword, (SELECT count(*) FROM k k2 WHERE k2.keyword = r.keyword) AS n, string_agg(text, '; ' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY keyword""")
def census_partitions(t: Tables) -> DataFrame:
    """AGG-12: words of partitions with examples."""
    return rp.partition_census(pr.census_headings(_lines(t, _MARKS))).withColumn("examples", F.array_join("examples", "; "))


@query(f"WITH {_SCAN}, f AS (SELECT level, text, min((doc, line_no)) AS place FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY place, text) AS k FROM f) SELECT level::BIGINT AS level, string_agg(text, '; ' ORDER BY k) FILTER (k <= 5) AS examples FROM r GROUP BY level")
def census_levels(t: Tables) -> DataFrame:
    """AGG-12: examples of each level of heading."""
    return rp.level_examples(pr.census_headings(_lines(t, _MARKS))).withColumn("examples", F.array_join("examples", "; "))


_FORM = "CASE WHEN doc_id % 5 = 0 THEN concat('PGh0bWw', text) WHEN doc_id % 5 = 1 THEN concat(repeat('aB3+/=', 12), text) WHEN doc_id % 5 = 2 THEN concat('---', chr(10), text) WHEN doc_id % 5 = 3 THEN concat('Uno', chr(10), '===', chr(10), text) ELSE text END"


@query(f"""WITH x AS (SELECT doc_id, source, {_FORM} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM x),
y AS (SELECT *, starts_with(text, 'PGh0bWw') OR regexp_matches(substr(text, 1, 64), '^[A-Za-z0-9+/=]{{64}}$') AS b FROM x)
SELECT source, count(*) AS files, count(*) FILTER (NOT b) AS markdown, count(*) FILTER (b) AS base64, count(*) FILTER (NOT b AND starts_with(text, concat('---', chr(10)))) AS front_matter, count(*) FILTER (NOT b AND doc_id % 5 <> 3) AS no_heading FROM y GROUP BY 1""")
def census_formats(t: Tables) -> DataFrame:
    """AGG-17, SRC-11: formats by collection; a title is put over a fifth of the documents, which have no headings of their own."""
    files = t("documents").select("doc_id", "source", F.expr(_FORM.replace("chr(10)", "'\\n'")).alias("text"))
    scan = pr.census_scan(pr.lines(files, "doc_id", "text"))
    return rp.format_census(files, scan, "source", "doc_id", "text")


_NAME = "CASE page_id % 7 WHEN 0 THEN concat('2018-01-0', page_id % 9 + 1, '_18G000', page_id % 90 + 10, '_ORIGINALE_V1.md') WHEN 1 THEN concat('18G000', page_id % 90 + 10, '.md') WHEN 2 THEN concat('Atto 18G000', page_id % 90 + 10, '_2.md') WHEN 3 THEN concat('Legge_', substr(md5(cast(page_id AS string)), 1, 12), '.md') WHEN 4 THEN concat('Legge ', page_id, '_', page_id % 5, '.md') WHEN 5 THEN concat('Legge ', page_id, '.md') ELSE concat(page_id, '.md') END"


@query(rf"""WITH x AS (SELECT page_id % 3 AS collection, {_NAME} AS name FROM pages), k AS (SELECT *, CASE WHEN regexp_matches(name, '^\d{{4}}-\d{{2}}-\d{{2}}_[0-9A-Z]+_(?:VIGENZA_\d{{4}}-\d{{2}}-\d{{2}}|ORIGINALE)_V\d+\.md$') THEN 'dated_code' WHEN regexp_matches(name, '^\d{{2,3}}[A-Z][0-9A-Z]{{4,5}}\.md$') THEN 'code'
WHEN regexp_matches(name, '[. ]\d{{2,3}}[A-Z][0-9A-Z]{{4,5}}(?:_\d+)?\.md$') THEN 'title_code' WHEN regexp_matches(name, '_[0-9a-f]{{12}}(?:_\d+)?\.md$') THEN 'title_hash' WHEN regexp_matches(name, '_\d+\.md$') THEN 'title_numbered' ELSE 'title' END AS class FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY collection, class ORDER BY name) AS k FROM k)
SELECT collection, class, count(*) AS n, string_agg(name, '; ' ORDER BY name) FILTER (k <= 2) AS examples FROM r GROUP BY 1, 2""")
def census_names(t: Tables) -> DataFrame:
    """FLT-10, AGG-18: names by shape, with two examples."""
    x = t("pages").select((F.col("page_id") % 3).alias("collection"), F.expr(_NAME).alias("name"))
    return rp.name_census(x, "collection", "name").withColumn("examples", F.array_join("examples", "; "))


@query("""SELECT o_orderstatus AS collection, name FROM (SELECT o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN concat('.h', o_orderkey::VARCHAR, '.md') WHEN 1 THEN concat(o_orderkey::VARCHAR, '.txt') ELSE concat(o_orderkey::VARCHAR, '.md') END AS name FROM orders) WHERE starts_with(name, '.') OR NOT ends_with(name, '.md')""")
def unexpected_entries(t: Tables) -> DataFrame:
    """SRC-12."""
    k = text_of("o_orderkey")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(".h"), k, F.lit(".md"))).when(F.col("o_orderkey") % 4 == 1, F.concat(k, F.lit(".txt"))).otherwise(F.concat(k, F.lit(".md")))
    return rp.unexpected_entries(t("orders").select(F.col("o_orderstatus").alias("collection"), name.alias("name")))


@query("""SELECT source AS name, n_chars AS size, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY size DESC, name LIMIT 5""")
def largest_duplicates(t: Tables) -> DataFrame:
    """TOP-09: the limit is the report."""
    d = rp.duplicate_census(t("documents").select(F.col("source").alias("name"), F.col("n_chars").alias("size")), "name", "size")
    return d.where("by_name = 0").orderBy(F.desc("size"), F.asc("name")).limit(5).select("name", "size", "n")


# Runs.


@query("""WITH c AS (SELECT l_orderkey % 500 AS lot, concat(l_orderkey::VARCHAR, '-', l_linenumber::VARCHAR) AS id, l_quantity < 48 AS ok FROM lineitem) SELECT lot, count(*) AS n_chunks, bool_and(id IN (SELECT id FROM c WHERE ok)) AS present FROM c GROUP BY 1""")
def present_lots(t: Tables) -> DataFrame:
    """SRC-09: lines as chunks, orders' lots as lots."""
    x = t("lineitem").select((F.col("l_orderkey") % 500).alias("lot"), F.concat_ws("-", text_of("l_orderkey"), text_of("l_linenumber")).alias("chunk_id"), "l_quantity")
    return bs.present_lots(x.select("lot", "chunk_id"), x.where("l_quantity < 48").select("chunk_id"))


@query("""SELECT concat('a/', o_orderkey::VARCHAR) AS file_path FROM orders WHERE o_orderkey % 6 NOT IN (0, 1)""")
def progress_left(t: Tables) -> DataFrame:
    """SNK-14: checkpoints without those of deleted and moved files."""
    path = F.concat(F.lit("a/"), text_of("o_orderkey"))
    o = t("orders")
    status = F.when(F.col("o_orderkey") % 6 == 0, "delete").when(F.col("o_orderkey") % 6 == 1, "move").otherwise("upsert")
    changes = o.select(status.alias("status"), F.when(status == "move", F.concat(F.lit("b/"), text_of("o_orderkey"))).otherwise(path).alias("path"), F.when(status == "move", path).alias("old_path"))
    return ing.drop_progress(o.select(path.alias("file_path")), changes)


@query("""SELECT count(*) AS n_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus = 'X') AS n_set FROM orders WHERE o_orderkey % 4 = 0""")
def status_rowcount(t: Tables) -> DataFrame:
    """SNK-06: a partial update and how many rows it met."""
    acts = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit("s").alias("sha"))
    new = acts.select("key").union(acts.select(-F.col("key"))).where("key % 4 = 0").select("key", F.lit("X").alias("status"), F.lit(None).cast("string").alias("sha"))
    after, met = ing.set_status(acts, new)
    return met.crossJoin(after.agg(F.count_if(F.expr("status = 'X' and sha = 's'")).alias("n_set")))


@query("""SELECT status, path, row_number() OVER (ORDER BY CASE status WHEN 'delete' THEN 0 WHEN 'move' THEN 1 ELSE 2 END, path) AS place FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'move' ELSE 'upsert' END AS status, o_orderkey::VARCHAR AS path FROM orders)""")
def processing_order(t: Tables) -> DataFrame:
    """TOP-11: every change with its place in the whole order."""
    status = F.when(F.col("o_orderkey") % 3 == 0, "delete").when(F.col("o_orderkey") % 3 == 1, "move").otherwise("upsert")
    changes = bs.processing_order(t("orders").select(status.alias("status"), text_of("o_orderkey").alias("path")))
    return in_lots(changes, [F.col("step"), F.col("path")], 1).select("status", "path", (F.col("lot") + 1).alias("place"))


@query("""SELECT event_type, round(avg(value), 6) AS mean_latency FROM events GROUP BY 1""")
def mean_latency(t: Tables) -> DataFrame:
    """AGG-05: values as latencies."""
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_latency"))


# Retrieval.


@query("""WITH c AS (SELECT l_orderkey AS act, l_linenumber AS article, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) - 1 AS split_no FROM lineitem),
k AS (SELECT *, concat('a', act, '#', article, '#', split_no) AS id FROM c), r AS (SELECT o_orderkey AS query_id, o_orderkey AS act, o_orderkey // 100 % 4 AS article FROM orders WHERE o_orderkey % 100 = 0),
e AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY split_no, id) AS rank, 0 AS tier FROM r JOIN k ON k.act = r.act AND k.article = r.article WHERE r.article > 0 QUALIFY rank <= 12),
h AS (SELECT query_id, k.id, row_number() OVER (PARTITION BY query_id ORDER BY k.l_partkey, k.id) AS rank, 1 AS tier FROM r JOIN k ON k.act = r.act),
u AS (SELECT query_id, id, min((tier, rank)) AS a FROM (SELECT * FROM e UNION ALL SELECT * FROM h) GROUP BY 1, 2)
SELECT query_id, id, a[1]::BIGINT AS tier, row_number() OVER (PARTITION BY query_id ORDER BY a[1], a[2], id) AS position FROM u QUALIFY position <= 5""")
def two_tier_search(t: Tables) -> DataFrame:
    """RET-13, FLT-08, TOP-02: an order's article hits, then its other lines."""
    act = lambda c: F.concat(F.lit("a"), text_of(c))
    c = t("lineitem").select(act("l_orderkey").alias("act_ref"), text_of("l_linenumber").alias("article"), "l_partkey")
    c = c.withColumn("split_no", F.row_number().over(Window.partitionBy("act_ref", "article").orderBy("l_partkey")) - 1)
    c = c.withColumn("chunk_id", F.concat_ws("#", "act_ref", "article", text_of("split_no"))).withColumn("legal_no", F.lit(0)).withColumn("split_no", F.substring_index("chunk_id", "#", -1).cast("int"))
    n = F.floor(F.col("o_orderkey") / 100) % 4
    o = t("orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("query_id"), act("o_orderkey").alias("act_ref"), F.when(n > 0, text_of(n)).alias("article"), F.lit(1).alias("ref_no"))
    hybrid = o.select("query_id", "act_ref").join(c, "act_ref").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("l_partkey", "chunk_id")))
    return pl.two_tier_search(o, c, hybrid.select("query_id", F.col("chunk_id").alias("id"), "rank"), 5)


@query("""SELECT l_orderkey AS query_id, l_suppkey AS act_ref, l_returnflag AS article, min(l_linenumber)::BIGINT AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey, l_returnflag) AS source_no FROM lineitem GROUP BY 1, 2, 3""")
def source_list(t: Tables) -> DataFrame:
    """SET-03: the sources of each order's lines."""
    x = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("act_ref"), F.col("l_returnflag").alias("article"), F.col("l_linenumber").alias("position"))
    return pl.source_list(x)


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag, coalesce(l_returnflag <> lag(l_returnflag) OVER w, true) AS shown FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)""")
def path_headers(t: Tables) -> DataFrame:
    """WIN-09: a path is shown where it differs from the one before."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    w = ch.neighbours(x, "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_returnflag")], "l_returnflag")
    return w.select("l_orderkey", "l_linenumber", "l_returnflag", F.coalesce(F.col("l_returnflag") != F.col("before"), F.lit(True)).alias("shown"))


@query("""WITH x AS (SELECT l_orderkey AS act_ref, l_suppkey % 3 AS article, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS occurrence FROM lineitem),
w AS (SELECT act_ref, article, pos FROM x WHERE occurrence = 1 AND article = 1)
SELECT x.act_ref, x.article, x.pos, x.occurrence, w.article AS wanted FROM x JOIN w ON w.act_ref = x.act_ref AND x.pos BETWEEN w.pos - 1 AND w.pos + 1""")
def article_window(t: Tables) -> DataFrame:
    """RET-14, WIN-03/08: the first article 1 of each order with its neighbours."""
    x = t("lineitem").select(F.col("l_orderkey").alias("act_ref"), (F.col("l_suppkey") % 3).alias("article"), "l_linenumber", "l_partkey", "l_suppkey")
    wanted = x.select("act_ref").distinct().withColumn("article", F.lit(1).cast("long"))
    return pl.article_window(x, wanted, [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])


# Streams.

_TURNS = "SELECT concat_ws('-', conv_id, turn) AS stream_id, coalesce(text, '') AS text, turn FROM conversations"


@query(f"""WITH c AS ({_TURNS}), x AS (SELECT stream_id, 0 AS part_no, 'text' AS kind, concat(text, ' ') AS payload, NULL AS act, NULL AS article, NULL AS comma FROM c
UNION ALL SELECT stream_id, 1, 'marker', '[[dlgs-81-2008|art.18|c.1|lett.a]]', 'dlgs-81-2008', '18', '1' FROM c UNION ALL SELECT stream_id, 2, 'marker', '[[no marker]]', NULL, NULL, NULL FROM c UNION ALL SELECT stream_id, 3, 'text', ' [[open ', NULL, NULL, NULL FROM c)
SELECT stream_id, part_no::BIGINT AS part_no, kind, payload, act, article, comma FROM x""")
def marker_stream(t: Tables) -> DataFrame:
    """STM-01, EXT-10: turns with markers in pieces of 17 characters; texts between markers are joined again."""
    parts = markers.split_streams(_cut_turns(t))
    w = Window.partitionBy("stream_id").orderBy("seq")
    marker = F.col("kind") == "marker"
    part = F.sum((marker | F.coalesce(F.lag(marker).over(w), F.lit(False))).cast("int")).over(w)
    each = parts.withColumn("part_no", part).groupBy("stream_id", "part_no", "kind").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("x"), F.max("act").alias("act"), F.max("article").alias("article"), F.max("comma").alias("comma"))
    return each.select("stream_id", "part_no", "kind", F.array_join(F.transform("x", lambda s: s["payload"]), "").alias("payload"), "act", "article", "comma")


def _cut_turns(t: Tables) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [[dlgs-81-2008|art.18|c.1|lett.a]][[no marker]] [[open "))
    c = t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), text.alias("text"))
    cut = c.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 17)), lambda k: F.substring(F.col("text"), (k * 17 + 1).cast("int"), F.lit(17)))).alias("seq", "delta"))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), "delta")


@query(f"""WITH c AS ({_TURNS}) SELECT stream_id, string_agg(e, ',' ORDER BY k) AS events, bool_or(verified) AS verified FROM (SELECT stream_id, k, e, CASE WHEN e = 'citation' THEN turn % 2 = 0 END AS verified FROM c, (VALUES (0, 'status'), (1, 'sources'), (2, 'text'), (3, 'token'), (4, 'citation'), (5, 'token'), (6, 'text'), (7, 'done')) v(k, e)) GROUP BY 1""")
def turn_events(t: Tables) -> DataFrame:
    """STM-02, JON-16: the wire's order; tokens of text are joined again, as their number hangs on the pieces."""
    parts = markers.split_streams(_cut_turns(t))
    turns = t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.lit("[[dlgs-81-2008|art.18|c.1|lett.a]]").alias("marker"), (F.col("turn") % 2 == 0).alias("verified"))
    got = events.turn_events(parts, turns)
    name = F.when((F.col("event") == "token") & ~F.startswith("payload", F.lit("[[")) | F.startswith("payload", F.lit("[[open")), "text").otherwise(F.col("event"))
    w = Window.partitionBy("stream_id").orderBy("event_no")
    named = got.withColumn("name", name).withColumn("new", F.coalesce((F.col("name") != "text") | (F.lag("name").over(w) != "text"), F.lit(True))).where("new")
    return named.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("event_no", "name"))).alias("x"), F.bool_or("verified").alias("verified")).select("stream_id", F.array_join(F.transform("x", lambda s: s["name"]), ",").alias("events"), "verified")


@query(None)
def request_admission(t: Tables) -> DataFrame:
    """STM-03/04, SCL-16, AGG-21: events as requests of 40 addresses and as many visitors as users."""
    ts = F.col("ts").cast("timestamp")
    done = F.timestamp_micros(F.unix_micros(ts) + (600 + F.col("event_id") % 7 * 300) * 1_000_000)
    x = t("events").select(F.col("event_id").alias("id"), ts.alias("ts"), done.alias("done"), text_of(F.col("user_id") % 40).alias("ip"), text_of("user_id").alias("cookie"))
    return admission.admit(x, 6, 2, "Europe/Rome", 1800)


# Scalars.


@query(r"""WITH x AS (SELECT *, concat('act', doc_id, '#art-', doc_id % 30, '.2#0') AS chunk_id, concat('10.0.0.', doc_id % 250, ', 192.168.0.', doc_id % 200) AS header FROM documents),
f AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\x00-\x1f]', '', 'g') AS flat FROM x)
SELECT x.doc_id, regexp_replace(lower(concat(lang, '-', source, ' (3)')), '[^\p{L}\p{N}]', '', 'g') AS model, concat('art-', (x.doc_id % 30)::VARCHAR, '-2') AS anchor, concat('--- [', chunk_id, '] Head', chr(10), regexp_replace(text, '^\n+', '')) AS context,
CASE WHEN length(flat) <= 120 THEN flat ELSE concat(substr(flat, 1, 119), '…') END AS flat, CASE WHEN x.doc_id % 4 = 0 THEN 'peer' ELSE concat('192.168.0.', (x.doc_id % 200)::VARCHAR) END AS address,
CASE WHEN x.doc_id % 2 = 0 THEN concat('0000000', x.doc_id % 10, '-1111-2222-3333-444444444444') ELSE 'fresh' END AS visitor, x.doc_id % 2 = 1 AS is_new FROM x JOIN f ON f.doc_id = x.doc_id""")
def more_scalars(t: Tables) -> DataFrame:
    """SCL-03/05/07/08/17/18."""
    n = F.col("doc_id")
    chunk_id = F.concat(F.lit("act"), text_of(n), F.lit("#art-"), text_of(n % 30), F.lit(".2#0"))
    header = F.when(n % 4 > 0, F.concat(F.lit("10.0.0."), text_of(n % 250), F.lit(", 192.168.0."), text_of(n % 200)))
    visitor, is_new = admission.visitor_id(F.when(n % 2 == 0, F.concat(F.lit("0000000"), text_of(n % 10), F.lit("-1111-2222-3333-444444444444"))).otherwise("no uuid"), F.lit("fresh"))
    context = tx.context_block(chunk_id, F.lit("Head"), F.concat(F.lit("Head\n\n"), "text"))
    return t("documents").select("doc_id", tx.model_slug(F.concat("lang", F.lit("-"), "source", F.lit(" (3)"))).alias("model"), tx.chunk_anchor(chunk_id, text_of(n)).alias("anchor"), context.alias("context"), tx.collapsed(F.col("text")).alias("flat"), admission.rightmost_address(header, F.lit("peer")).alias("address"), visitor.alias("visitor"), is_new.alias("is_new"))


@query("""WITH x AS (SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000 AS days, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events) SELECT event_id, round(days, 6) AS days, ceil(days)::BIGINT AS shown, stamp FROM x""")
def event_ages(t: Tables) -> DataFrame:
    """SCL-15/20."""
    ts = F.col("ts").cast("timestamp")
    days, shown = tx.age_in_days(F.to_timestamp(F.lit("2024-02-01 00:00:00")), ts)
    return t("events").select("event_id", F.round(days, 6).alias("days"), shown.alias("shown"), tx.file_stamp(ts).alias("stamp"))


_HINTS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(COLLECTION_TYPE.values()))


@query(f"""SELECT doc_id, CASE doc_id % 25 {_HINTS} WHEN 23 THEN replace(trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')), ' ', '_') ELSE 'atto_normativo' END AS act_type FROM documents""")
def collection_hint(t: Tables) -> DataFrame:
    """REF-11: the type that each collection's name suggests, an unknown one's own words."""
    names = F.array(*map(F.lit, COLLECTION_TYPE), F.col("source"), F.lit("!"))
    return t("documents").select("doc_id", idn.type_of_collection(names[(F.col("doc_id") % 25).cast("int")]).alias("act_type"))


@query(r"""SELECT doc_id, len(regexp_extract_all(x, '\(\(|\)\)'))::BIGINT AS tokens, contains(x, '((') AS amended, doc_id % 3 = 0 AS whole, doc_id % 6 = 1 AS self_numbered, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS links
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('((', translate(text, '()', '  '), '))') WHEN 1 THEN concat((doc_id + doc_id // 3 % 2)::VARCHAR, '. ', translate(text, '()', '  ')) ELSE concat(translate(text, '()', '  '), ' ((') END AS x FROM documents)""".replace("doc_id % 6 = 1 AS self_numbered", "doc_id % 3 = 1 AND doc_id // 3 % 2 = 0 AS self_numbered"))
def norm_text_marks(t: Tables) -> DataFrame:
    """UI-02/03/04/05 over whole texts: marks, wholly amended texts, paragraphs that number themselves, links that are opened."""
    n = F.col("doc_id")
    bare = F.translate("text", "()", "  ")
    number = n + F.floor(n / 3) % 2
    x = F.when(n % 3 == 0, F.concat(F.lit("(("), bare, F.lit("))"))).when(n % 3 == 1, F.concat(text_of(number), F.lit(". "), bare)).otherwise(F.concat(bare, F.lit(" ((")))
    links = F.concat(F.lit("[a](http://x/1) [b](ftp://x/2)"), F.when(n % 2 == 0, " [c](https://x/3)").otherwise(""))
    d = t("documents").select("doc_id", x.alias("x"), links.alias("l"))
    return d.select("doc_id", tx.amendment_marks(F.col("x")).alias("tokens"), F.contains("x", F.lit("((")).alias("amended"), tx.wholly_amended(F.array("x")).alias("whole"), tx.self_numbered(text_of("doc_id"), F.col("x")).alias("self_numbered"), F.size(tx.open_links(F.col("l"))).alias("links"))

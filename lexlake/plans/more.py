"""Further queries: conversations, census, scalars, feedback, limits, grammar, pages, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dims import MONTHS
from ..operators import citations as ci
from ..operators import embedding as em
from ..operators import identity as idn
from ..operators import pipeline as pl
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..sources import html
from ..streaming import limits
from .queries import Tables, query


@query("""WITH u AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY 1),
b AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS back FROM conversations c JOIN u ON u.conv_id = c.conv_id AND c.turn < u.last_turn)
SELECT conv_id, turn, role, back, substr(text, 1, 1500) AS text FROM b WHERE back <= 6""")
def conversation_context(t: Tables) -> DataFrame:
    """WIN-06/07: up to six turns before the last user turn, each cut at 1500 characters."""
    c = t("conversations")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    back = c.join(last, "conv_id").where("turn < last_turn").withColumn("back", F.row_number().over(w)).where("back <= 6")
    return back.select("conv_id", "turn", "role", "back", F.substring("text", 1, 1500).alias("text"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations QUALIFY role = 'assistant'""")
def preceding_user_turn(t: Tables) -> DataFrame:
    """JON-15: a backward as-of match as a window."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = t("conversations").select("conv_id", "turn", "role")
    return c.withColumn("user_turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)).where("role = 'assistant'").select("conv_id", "turn", "user_turn")


@query("""WITH c AS (SELECT l_orderkey, min(l_suppkey) AS one, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN n = 1 THEN one END AS act FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 OR n = 1""")
def bind_unbound(t: Tables) -> DataFrame:
    """JON-17, AGG-19: a reference without act takes the context's act if there is just one, else it is dropped."""
    context = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("one"), F.max("l_suppkey").alias("other"))
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("own"))
    got = o.join(context.where("one = other"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return got.select("o_orderkey", F.coalesce("own", "one").alias("act")).where("act is not null")



@query("""WITH k AS (SELECT source, n_chars::DOUBLE AS x, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
h AS (SELECT *, unnest([1, 2, 3]) AS q FROM k), j AS (SELECT *, greatest(1, least(q * (n + 1) // 4, n - 1)) AS j FROM h),
g AS (SELECT source, q, max(n) AS n, CASE WHEN max(n) = 1 THEN max(x) ELSE sum(CASE WHEN i = j THEN x * (4 - (q * (n + 1) - 4 * j)) WHEN i = j + 1 THEN x * (q * (n + 1) - 4 * j) ELSE 0 END) / 4 END AS v FROM j GROUP BY 1, 2)
SELECT g.source, max(g.n)::BIGINT AS n, max(least) AS least, trunc(max(v) FILTER (q = 1))::BIGINT AS q1, trunc(max(v) FILTER (q = 2))::BIGINT AS q2, trunc(max(v) FILTER (q = 3))::BIGINT AS q3, max(most) AS most, max(mean) AS mean FROM g JOIN (SELECT source, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1) m ON m.source = g.source GROUP BY 1""")
def size_quartiles(t: Tables) -> DataFrame:
    """AGG-13: the exclusive method."""
    return rp.exclusive_quartiles(t("documents"), "source", "n_chars")


@query(r"""WITH x AS (SELECT source, concat(text, CASE WHEN doc_id % 4 = 0 THEN repeat(chr(0), 1500) WHEN doc_id % 4 = 1 THEN repeat(' ', 40) ELSE '' END) AS text FROM documents),
p AS (SELECT source, octet_length(encode(text)) - octet_length(encode(rtrim(text, concat(chr(0), ' ', chr(10), chr(9), chr(13))))) AS pad FROM x)
SELECT source, count(*) FILTER (pad > 1024) AS padded, sum(CASE WHEN pad > 1024 THEN pad ELSE 0 END)::BIGINT AS padding_bytes FROM p GROUP BY 1""")
def padding_stats(t: Tables) -> DataFrame:
    """AGG-14, SRC-11."""
    pad = F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("\x00"), F.lit(1500))).when(F.col("doc_id") % 4 == 1, F.repeat(F.lit(" "), F.lit(40))).otherwise("")
    return rp.padding(t("documents").select("source", F.concat("text", pad).alias("text")), "source", "text", 1024)


@query("""SELECT source AS name, n_chars AS size, count(*) AS n, grouping(n_chars)::BIGINT AS by_name FROM documents GROUP BY GROUPING SETS ((source), (source, n_chars)) HAVING count(*) > 1""")
def duplicate_census(t: Tables) -> DataFrame:
    """AGG-15, TOP-09."""
    return rp.duplicate_census(t("documents").select(F.col("source").alias("name"), F.col("n_chars").alias("size")), "name", "size")


@query("""SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)""")
def inventory_rollup(t: Tables) -> DataFrame:
    """AGG-16, SRC-12."""
    return t("documents").rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("""SELECT source, doc_id, sample_rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id::VARCHAR, ':42')), doc_id) AS sample_rank FROM documents) WHERE sample_rank <= 5""")
def sample_per_group(t: Tables) -> DataFrame:
    """TOP-10."""
    return rp.sample_per_group(t("documents").select("source", "doc_id"), "source", F.col("doc_id"), 5, 42)


@query("""(SELECT 'largest' AS side, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL (SELECT 'smallest', doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10)""")
def extreme_sizes(t: Tables) -> DataFrame:
    """TOP-07: the limit is the report."""
    d = t("documents").select("doc_id", "n_chars")
    side = lambda name, *order: d.orderBy(*order, "doc_id").limit(10).select(F.lit(name).alias("side"), "doc_id", "n_chars")
    return side("largest", F.desc("n_chars")).union(side("smallest", F.asc("n_chars")))


@query(r"""WITH x AS (SELECT doc_id, text, n_chars, replace(text, chr(10), ' ') AS head FROM documents),
y AS (SELECT *, trim(regexp_replace(replace(lower(regexp_replace(strip_accents(head), '[^\x00-\x7f]', '', 'g')), '.', ''), '[^a-z0-9]+', ' ', 'g')) AS words,
trim(CASE WHEN starts_with(text, substr(text, 1, 20)) THEN substr(text, 21) ELSE text END) AS body FROM x)
SELECT doc_id, words, replace(words, ' ', '-') AS slug, regexp_replace(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor,
CASE WHEN length(body) <= 240 THEN body ELSE concat(regexp_replace(CASE WHEN contains(substr(body, 1, 240), ' ') THEN regexp_extract(substr(body, 1, 240), '(?s)^(.*) [^ ]*$', 1) ELSE substr(body, 1, 240) END, '[ ,;:.]+$', ''), '…') END AS snippet,
CASE WHEN length(text) <= 80 THEN text ELSE concat(rtrim(CASE WHEN contains(substr(text, 1, 79), ' ') THEN regexp_extract(substr(text, 1, 79), '(?s)^(.*) [^ ]*$', 1) ELSE substr(text, 1, 79) END), '…') END AS short,
CASE WHEN n_chars >= 1048576 THEN concat(format('{:.1f}', floor(n_chars * 10 / 1048576) / 10), ' MB') WHEN n_chars >= 1024 THEN concat(format('{:.1f}', floor(n_chars * 10 / 1024) / 10), ' KB') ELSE concat(n_chars::VARCHAR, ' B') END AS size,
round_even(n_chars / 2.26, 0)::BIGINT AS tokens FROM y""")
def text_scalars(t: Tables) -> DataFrame:
    """REF-05, SCL-04/06/10/11, CHK-10."""
    d = t("documents").withColumn("head", F.replace("text", F.lit("\n"), F.lit(" ")))
    x = F.col("head")
    return d.select("doc_id", tx.normalize_words(x).alias("words"), tx.slug(x).alias("slug"), tx.anchor_slug(x).alias("anchor"), tx.snippet(F.col("text"), F.substring("text", 1, 20)).alias("snippet"), tx.truncate_words(F.col("text"), 80).alias("short"), tx.human_size(F.col("n_chars")).alias("size"), tx.token_estimate(F.col("n_chars")).alias("tokens"))


_ROMAN = "concat(repeat('M', o_orderkey % 4), split_part(',C,CC,CCC,CCCC,CD,D,DC,DCC,CM', ',', {c} % 10 + 1), split_part(',X,XX,XXX,XL,L,LX,LXX,LXXX,XC', ',', {x} % 10 + 1), split_part(',I,II,III,IIII,IV,V,VI,VII,IX', ',', {i} % 10 + 1))"


@query(f"""SELECT o_orderkey, {_ROMAN.format(c='(o_orderkey // 10)', x='(o_orderkey // 100)', i='o_orderkey')} AS roman, ((o_orderkey % 4) * 1000 + list_extract([0, 100, 200, 300, 400, 400, 500, 600, 700, 900], (o_orderkey // 10) % 10 + 1) + list_extract([0, 10, 20, 30, 40, 50, 60, 70, 80, 90], (o_orderkey // 100) % 10 + 1) + list_extract([0, 1, 2, 3, 4, 4, 5, 6, 7, 9], o_orderkey % 10 + 1))::BIGINT AS value FROM orders""")
def roman_to_int(t: Tables) -> DataFrame:
    """REF-03: additive forms too."""
    o = t("orders").select("o_orderkey", F.expr(_ROMAN.format(c="(o_orderkey div 10)", x="(o_orderkey div 100)", i="o_orderkey").replace("repeat('M', o_orderkey % 4)", "repeat('M', cast(o_orderkey % 4 as int))").replace("% 10 + 1)", "% 10 + 1)").replace("', ',', ", "', ',', cast(").replace(" % 10 + 1)", " % 10 + 1 as int))")).alias("roman"))
    return o.select("o_orderkey", "roman", tx.roman_value(F.col("roman")).alias("value"))


_URN = "concat('see <a href=\"urn:nir:stato:', CASE WHEN page_id % 3 = 0 THEN 'legge' WHEN page_id % 3 = 1 THEN 'decreto.legislativo' ELSE 'regio.decreto' END, ':', 1900 + page_id % 120, CASE WHEN page_id % 2 = 0 THEN '-05-17' ELSE '' END, ';', page_id, '!vig\">')"


@query(rf"""WITH x AS (SELECT page_id, {_URN} AS s FROM pages), y AS (SELECT page_id, regexp_extract(s, 'urn:nir:stato:([a-z.]+):', 1) AS kind, regexp_extract(s, ':(\d{{4}})', 1) AS y, regexp_extract(s, ':(\d{{4}}-\d{{2}}-\d{{2}});', 1) AS d, regexp_extract(s, ';(\d+)', 1) AS number FROM x)
SELECT page_id, CASE kind WHEN 'legge' THEN concat('legge-', number, '-', y) WHEN 'decreto.legislativo' THEN concat('dlgs-', number, '-', y) ELSE concat('rd-', number, '-', y) END AS act_ref, CASE kind WHEN 'legge' THEN 'legge' WHEN 'decreto.legislativo' THEN 'decreto_legislativo' ELSE 'regio_decreto' END AS act_type, number, y::BIGINT AS year, nullif(d, '') AS date FROM y""")
def urn_identity(t: Tables) -> DataFrame:
    """REF-04/08."""
    x = t("pages").select("page_id", idn.from_urn(F.expr(_URN)).alias("r"))
    return x.select("page_id", "r.act_ref", "r.act_type", "r.number", "r.year", F.col("r.date").cast("string").alias("date"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 3 AS k, (o_orderkey % 28 + 1)::VARCHAR AS day, (1950 + o_orderkey % 70)::VARCHAR AS y, o_orderkey::VARCHAR AS n, o_orderkey % 12 AS m FROM orders)
SELECT o_orderkey, concat(CASE k WHEN 0 THEN 'legge' WHEN 1 THEN 'dlgs' ELSE 'rdl' END, '-', n, '-', y) AS act_ref, CASE k WHEN 0 THEN 'legge' WHEN 1 THEN 'decreto_legislativo' ELSE 'regio_decreto_legge' END AS act_type, y::BIGINT AS year, concat(y, '-', lpad((m + 1)::VARCHAR, 2, '0'), '-', lpad(day, 2, '0')) AS date, concat(CASE k WHEN 0 THEN 'Legge ' WHEN 1 THEN 'Decreto Legislativo ' ELSE 'Regio Decreto-Legge ' END, n, '/', y) AS label FROM x""")
def header_identity(t: Tables) -> DataFrame:
    """REF-01/02, UI-01, SCL-14: headers written from order keys, read back."""
    month = F.array(*map(F.lit, MONTHS))[(F.col("o_orderkey") % 12).cast("int")]
    kind = F.when(F.col("o_orderkey") % 3 == 0, "LEGGE").when(F.col("o_orderkey") % 3 == 1, "DECRETO LEGISLATIVO").otherwise("REGIO DECRETO-LEGGE")
    title = F.concat(kind, F.lit(" "), (F.col("o_orderkey") % 28 + 1).cast("string"), F.lit(" "), month, F.lit(" "), (1950 + F.col("o_orderkey") % 70).cast("string"), F.lit(", n. "), F.col("o_orderkey").cast("string"), F.lit(" (18G00011)"))
    null = F.lit(None).cast("string")
    titled = t("orders").select("o_orderkey", title.alias("title"))
    r = idn.with_identity(titled, F.col("title"), null, null, F.lit("Leggi/x.md"), F.lit("legge"), "r")
    return r.select("o_orderkey", "r.act_ref", "r.act_type", "r.year", F.col("r.date").cast("string").alias("date"), idn.act_label(F.col("r.act_ref")).alias("label"))


@query("""SELECT doc_id, lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)), concat(list_extract(['8', '9', 'a', 'b'], (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1), substr(h, 18, 3)), substr(h, 21, 12))) AS uuid FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('doc#', doc_id::VARCHAR))) AS h FROM documents)""")
def point_uuid(t: Tables) -> DataFrame:
    """SCL-02."""
    return t("documents").select("doc_id", tx.uuid5_url(F.concat(F.lit("doc#"), F.col("doc_id").cast("string"))).alias("uuid"))


_RATED = "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 END"
_CONFIG = "concat('cfg', cast(cast(json_extract_string(props, '$.k') AS BIGINT) % 4 AS VARCHAR))"


@query(f"""WITH r AS (SELECT {_RATED} AS rating, {_CONFIG} AS config FROM events WHERE event_type IN ('purchase', 'signup', 'error')) SELECT config, count(*) AS n, count(*) FILTER (rating = 1) AS up, round(count(*) FILTER (rating = 1) / count(*), 6) AS up_rate FROM r GROUP BY ROLLUP (config)""")
def feedback_report(t: Tables) -> DataFrame:
    """AGG-07/08, TOP-08, SCL-09: events as ratings."""
    rows = t("events").withColumn("rating", F.expr(_RATED)).where("rating is not null")
    return rp.feedback_rates(rows, F.concat(F.lit("cfg"), (F.get_json_object("props", "$.k").cast("long") % 4).cast("string")))


@query("""SELECT event_id, user_id, ts::VARCHAR AS ts FROM events WHERE event_type = 'error' ORDER BY events.ts DESC, event_id DESC LIMIT 20""")
def recent_negatives(t: Tables) -> DataFrame:
    """FLT-06: the limit is the report."""
    e = t("events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return e.select("event_id", "user_id", F.col("ts").cast("string").alias("ts"))


@query("""SELECT event_id, user_id, place, place <= 3 AS admitted FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS place FROM events)""")
def daily_limit(t: Tables) -> DataFrame:
    """STM-03, SCL-16, AGG-21."""
    return limits.daily_admission(t("events").select("event_id", "user_id", "ts"), "user_id", F.col("ts"), "event_id", 3).select("event_id", "user_id", "place", "admitted")


@query("""WITH x AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 300 + event_id % 5 * 3600 AS b FROM events), e AS (SELECT user_id, a AS moment, 1 AS s FROM x UNION ALL SELECT user_id, b, -1 FROM x), g AS (SELECT user_id, moment, s, sum(s) AS n FROM e GROUP BY 1, 2, 3),
o AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY moment, s ROWS UNBOUNDED PRECEDING) AS open FROM g) SELECT user_id, max(open)::BIGINT AS peak FROM o GROUP BY 1""")
def concurrency_peak(t: Tables) -> DataFrame:
    """STM-04."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    x = t("events").select("user_id", s.alias("a"), (s + 300 + F.col("event_id") % 5 * 3600).alias("b"))
    return limits.peak_concurrency(x, "user_id", F.col("a"), F.col("b"))


@query("""WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS moment FROM events WHERE event_type = 'error'), r AS (SELECT user_id, min(moment) AS moment FROM e GROUP BY 1
UNION ALL SELECT r.user_id, min(e.moment) FROM r JOIN e ON e.user_id = r.user_id AND e.moment >= r.moment + 86400 GROUP BY r.user_id) SELECT user_id, moment FROM r""")
def alert_dedup(t: Tables) -> DataFrame:
    """STM-05, SNK-13."""
    e = t("events").where("event_type = 'error'").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return limits.sent_alerts(e, "user_id", F.col("at"), F.lit(True), 86400).withColumnRenamed("at", "moment")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_events(t: Tables) -> DataFrame:
    """Extension: event-time windows, the same plan on a stream."""
    w = limits.windowed_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 hour", "event_type")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("SELECT doc_id, 0::BIGINT AS pos, concat('dlgs-', doc_id % 90 + 1, '-2008') AS act_ref, 'decreto_legislativo' AS act_type, (doc_id % 90 + 1)::VARCHAR AS number, 2008::BIGINT AS year, (doc_id % 300 + 1)::VARCHAR AS article, '2' AS comma FROM documents UNION ALL SELECT doc_id, 1, 'codice-civile', 'codice', NULL, NULL, '5', NULL FROM documents UNION ALL SELECT doc_id, 2, 'codice-civile', 'codice', NULL, NULL, '7', NULL FROM documents")
def grammar_refs(t: Tables) -> DataFrame:
    """EXT-01..04, FLT-12, SET-09: references put into the documents' texts, and read back."""
    ref = F.concat(F.lit(" art. "), (F.col("doc_id") % 300 + 1).cast("string"), F.lit(", comma 2, del d.lgs. "), (F.col("doc_id") % 90 + 1).cast("string"), F.lit("/2008; artt. 5 e 7 c.c. "))
    x = t("documents").select("doc_id", F.concat("text", ref).alias("text"))
    return ci.with_references(x, "text").select("doc_id", F.posexplode("refs").alias("pos", "r")).select("doc_id", "pos", "r.*")


@query(None)
def html_extract(t: Tables) -> DataFrame:
    """Extension: title, shown text and links of raw pages."""
    return html.page_contents(t("pages")).drop("error")


@query("""SELECT page_id, CASE WHEN page_id % 7 = 3 THEN 'AssertionError' WHEN page_id % 11 = 4 THEN 'ValueError' END AS error, CASE WHEN page_id % 7 <> 3 AND page_id % 11 <> 4 THEN coalesce(octet_length(encode(html)), 0) END AS n_bytes FROM pages""")
def error_rows(t: Tables) -> DataFrame:
    """PRS-13, SRC-04: pages with broken markup, a declaration that the parser rejects or tags that never end, each become one row of an error."""
    p = t("pages").withColumn("n_bytes", F.coalesce(F.octet_length("html"), F.lit(0)))
    broken = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("<![foo["), "html")).when(F.col("page_id") % 11 == 4, F.concat("html", F.repeat(F.lit("<a "), F.lit(20_000)))).otherwise(F.col("html"))
    parsed = html.captured_pages(p.withColumn("html", broken), "page_id", "html")
    found = parsed.groupBy("id").agg(F.max(F.substring_index("error", ":", 1)).alias("error"), F.count("*").alias("n"))
    failed = html.dead_letters(parsed, "pages").groupBy("id").agg(F.count("*").alias("n_errors"))
    out = p.join(found, p.page_id == found.id).join(failed, "id", "left")
    # An error stands alone: one row for its page.
    return out.where("error is null or (n = 1 and n_errors = 1)").select("page_id", "error", F.when(F.col("error").isNull(), F.col("n_bytes")).alias("n_bytes"))


@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('CAPO ', doc_id % 9, ' - CAPO ', doc_id % 9, ' ', source) WHEN 1 THEN concat('CAPO ', doc_id % 9, ' CAPO ', doc_id % 7, ' ', source) ELSE concat('Titolo ', source) END AS label, concat('[', source, '](http://x/', doc_id, ') di  legge (18G000', doc_id % 90 + 10, ')') AS title FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 9 = doc_id % 7) THEN regexp_replace(label, '^CAPO \d+ (- )?', '') ELSE label END AS label, concat(regexp_extract(title, '\[([^\]]*)\]', 1), ' di legge') AS title, concat('Oggetto ', doc_id::VARCHAR) AS rubric FROM x""")
def label_cleanup(t: Tables) -> DataFrame:
    """UI-06, CHK-08/09: labels, titles, rubrics."""
    d = t("documents")
    k = lambda n: (F.col("doc_id") % n).cast("string")
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CAPO "), k(9), F.lit(" - CAPO "), k(9), F.lit(" "), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("CAPO "), k(9), F.lit(" CAPO "), k(7), F.lit(" "), "source")).otherwise(F.concat(F.lit("Titolo "), "source"))
    title = F.concat(F.lit("["), "source", F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(") di  legge (18G000"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(")"))
    return d.select("doc_id", tx.partition_label(label).alias("label"), tx.clean_title(title).alias("title"), tx.clean_rubric(F.concat(F.lit("Oggetto  "), F.col("doc_id").cast("string"), F.lit(" (Articolo 3,\ncomma 1)"))).alias("rubric"))


@query("""WITH c AS (SELECT l_orderkey AS act, l_linenumber AS article, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) - 1 AS split_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS legal_no FROM lineitem),
k AS (SELECT *, concat('a', act, '#', article, '#', split_no) AS chunk_id FROM c),
r AS (SELECT o_orderkey AS query_id, o_orderkey AS act, o_orderkey // 100 % 4 AS article FROM orders WHERE o_orderkey % 100 = 0),
e AS (SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY split_no, chunk_id) AS rank, 0 AS tier FROM r JOIN k ON k.act = r.act AND k.article = r.article WHERE r.article > 0 QUALIFY rank <= 12),
b AS (SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY legal_no, chunk_id) AS rank, 2 AS tier FROM r JOIN k ON k.act = r.act WHERE r.article = 0 QUALIFY rank <= 2),
h AS (SELECT query_id, k.chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY k.l_partkey, k.chunk_id) AS rank, 1 AS tier FROM r JOIN k ON k.act = r.act QUALIFY rank <= 3),
u AS (SELECT query_id, id, min((tier, rank)) AS a FROM (SELECT * FROM e UNION ALL SELECT * FROM b UNION ALL SELECT * FROM h) GROUP BY 1, 2)
SELECT query_id, id, a[1]::BIGINT AS tier, row_number() OVER (PARTITION BY query_id ORDER BY a[1], a[2], id) AS position FROM u QUALIFY position <= 7""")
def retrieve_tiers(t: Tables) -> DataFrame:
    """RET-08/12, TOP-03/06: orders as acts, their lines as chunks."""
    c = t("lineitem").select(F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("act_ref"), F.col("l_linenumber").cast("string").alias("article"), "l_orderkey", "l_linenumber", "l_partkey")
    c = c.withColumn("split_no", F.row_number().over(Window.partitionBy("act_ref", "article").orderBy("l_partkey")) - 1).withColumn("legal_no", F.row_number().over(Window.partitionBy("act_ref").orderBy("l_linenumber", "l_partkey")))
    c = c.withColumn("chunk_id", F.concat_ws("#", "act_ref", "article", F.col("split_no").cast("string")))
    n = F.floor(F.col("o_orderkey") / 100) % 4
    o = t("orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("act_ref"), F.when(n > 0, n.cast("string")).alias("article"), F.lit(1).alias("ref_no"))
    hybrid = rt.top_per(o.select("query_id", "act_ref").join(c, "act_ref"), ["query_id"], [F.asc("l_partkey"), F.asc("chunk_id")], 3)
    return pl.retrieve(o, c, hybrid.select("query_id", F.col("chunk_id").alias("id"), "rank"), 3)


@query("""WITH x AS (SELECT doc_id, concat(text, ' di cui all''articolo ', doc_id + 1, ' e all''art. ', doc_id + 2, ' della legge 7 agosto 1990, n. 241 ') AS text FROM documents),
c AS (SELECT q.doc_id AS query_id, x.doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY x.doc_id) AS place, greatest(1, length(x.text) // 4) AS cost FROM documents q JOIN x ON x.doc_id IN (q.doc_id + 1, q.doc_id + 2) WHERE q.doc_id % 100 = 0)
SELECT query_id, chunk_id, place, sum(cost) OVER (PARTITION BY query_id ORDER BY place)::BIGINT AS spent FROM c QUALIFY spent <= 6000""")
def follow_citations(t: Tables) -> DataFrame:
    """RET-09, JON-06, EXT-06/09: documents as articles whose texts cite the next ones."""
    n = F.col("doc_id")
    cite = F.concat(F.lit(" di cui all'articolo "), (n + 1).cast("string"), F.lit(" e all'art. "), (n + 2).cast("string"), F.lit(" della legge 7 agosto 1990, n. 241 "))
    c = t("documents").select(n.cast("string").alias("chunk_id"), F.lit("legge-241-1990").alias("act_ref"), n.cast("string").alias("article"), F.lit(0).alias("split_no"), n.alias("legal_no"), F.concat("text", cite).alias("text"))
    hits = c.where("cast(chunk_id as long) % 100 = 0").withColumns({"query_id": F.col("chunk_id").cast("long"), "position": F.lit(1)})
    return pl.follow_citations(hits, c, 6000)


@query(None)
def embed_texts(t: Tables) -> DataFrame:
    """RET-06/07: the stand-in model's vectors."""
    return em.embed(t("documents").select("doc_id", "text"), "text").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))

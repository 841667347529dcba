"""Structural parsing of lines into events, articles and numbered paragraphs, as windows over a document's lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import PARTITIONS, SUFFIX_PATTERN, SUFFIXES

PARAGRAPH = rf"^(\d+)(?:-({SUFFIX_PATTERN}))?\.\s"


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, line), numbered from 1."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("at", "line")).select("doc", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def line_events(rows: DataFrame) -> DataFrame:
    """(doc, line_no, kind, payload): kinds h1, h2, atx, line, blank.

    An underline makes a heading of all the plain lines right above it and takes their place; one after a
    blank line or an ATX heading is dropped. A plain line's fate is told by the next line that isn't plain.
    """
    line = F.col("line")
    kind = F.when(F.trim(F.regexp_replace(line, r"\s+", " ")) == "", "blank").when(line.rlike(r"^#{1,6}\s"), "atx").when(line.rlike(r"^=+\s*$"), "h1").when(line.rlike(r"^-{2,}\s*$"), "h2").otherwise("line")
    w = Window.partitionBy("doc").orderBy("line_no")
    k = rows.withColumn("kind", kind).withColumn("plain", F.col("kind") == "line")
    k = k.withColumn("block", F.sum(F.when(F.col("plain"), 0).otherwise(1)).over(w)).withColumn("follows_plain", F.coalesce(F.lag("plain").over(w), F.lit(False)))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    k = k.withColumn("next_kind", F.first(F.when(~F.col("plain"), F.col("kind")), ignorenulls=True).over(ahead))
    heads = k.where(F.col("plain") & F.col("next_kind").isin("h1", "h2")).groupBy("doc", "block", F.col("next_kind").alias("kind")).agg(
        (F.max("line_no") + 1).alias("line_no"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"]))).alias("payload")
    )
    rest = k.where(F.col("kind").isin("blank", "atx") | (F.col("plain") & ~F.coalesce(F.col("next_kind").isin("h1", "h2"), F.lit(False))))
    payload = F.when(F.col("kind") == "blank", "").when(F.col("kind") == "atx", F.trim("line")).otherwise(F.col("line"))
    return heads.select("doc", "line_no", "kind", "payload").unionByName(rest.select("doc", "line_no", "kind", payload.alias("payload")))


#: An article's number: digits, then perhaps a suffix set off by a space, a dot or a hyphen.
_N, _SUFFIX, _END = r"(\d+)", rf"(?:[ .-]+({SUFFIX_PATTERN}))?", r"\.?\s*$"
ATX = rf"^###\s+Art\.?\s*{_N}{_SUFFIX}{_END}"
SETEXT = rf"^Art\.?\s+{_N}{_SUFFIX}{_END}"
ONLY = rf"(?i)^#* *Articolo\s+unico{_END}"
_PARTITION = rf"(?i)^({'|'.join(PARTITIONS)})\b"


def plain_marker(line: Column) -> Column:
    """(annex, base, suffix) of a line that ends in "-art. " and a number, perhaps of two halves and with a suffix; else null."""
    words = F.split(F.trim(F.regexp_replace(F.substring_index(line, "-art.", -1), r"\s+", " ")), " ")
    annex = F.substr(line, F.lit(1), F.length(line) - F.length(F.substring_index(line, "-art.", -1)) - 5)
    halves = F.split(words[0], "/")
    numbers = (F.size(halves) <= 2) & F.forall(halves, lambda x: (x != "") & (F.translate(x, "0123456789", "") == ""))
    suffix = F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))
    spaced = F.substr(F.substring_index(line, "-art.", -1), F.lit(1), F.lit(1)).rlike(r"\s")
    named = (annex != "") & ~F.substr(annex, F.lit(1), F.lit(1)).rlike(r"\s")
    found = named & spaced & numbers & ((F.size(words) == 1) | ((F.size(words) == 2) & suffix.isin(*SUFFIXES)))
    return F.when(F.contains(line, F.lit("-art.")), F.when(found, F.struct(annex.alias("annex"), words[0].alias("base"), suffix.alias("suffix"))))


def article_style(plain: Column | None = None) -> Column:
    """How an event (kind, payload) marks an article, null if it doesn't; plain is its plain_marker, if that is at hand."""
    p, kind = F.col("payload"), F.col("kind")
    return F.when((kind == "atx") & (p.rlike(ATX) | p.rlike(ONLY)), "atx").when((kind == "h2") & (p.rlike(SETEXT) | p.rlike(ONLY)), "setext").when((kind == "line") & (plain_marker(p) if plain is None else plain).isNotNull(), "plain")


def article_number(base: Column, suffix: Column) -> Column:
    return F.when(suffix == "", base).otherwise(F.concat(base, F.lit("-"), suffix))


def articles(events: DataFrame) -> DataFrame:
    """(doc, article_no, number, style, path, body): a marker opens an article, which takes the lines up to the next marker or closing heading.

    Closing are level-1 headings, and ATX and level-2 headings that aren't markers. path is the last partition
    heading before the marker. A document without articles is one, "unico", of all its text.
    """
    p, kind = F.col("payload"), F.col("kind")
    events = events.withColumn("marker", F.when(kind == "line", plain_marker(p)))
    atx, setext, plain, only = ATX, SETEXT, F.col("marker"), ONLY
    style = article_style(plain)
    number = F.when(kind.isin("atx", "h2") & p.rlike(only), "unico").when(kind == "atx", article_number(F.regexp_extract(p, atx, 1), F.regexp_extract(p, atx, 2)))
    number = number.when(kind == "h2", article_number(F.regexp_extract(p, setext, 1), F.regexp_extract(p, setext, 2))).otherwise(article_number(plain["base"], plain["suffix"]))
    w = Window.partitionBy("doc").orderBy("line_no")
    e = events.withColumn("style", style).withColumn("number", F.when(style.isNotNull(), number))
    opens = F.col("style").isNotNull()
    e = e.withColumn("bound", F.when(opens, F.lit(True)).when(kind.isin("h1", "atx", "h2"), F.lit(False)))
    e = e.withColumn("inside", F.coalesce(F.last("bound", ignorenulls=True).over(w), F.lit(False))).withColumn("article_no", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    part = F.last(F.when((kind == "h2") & F.col("style").isNull() & p.rlike(_PARTITION), p), ignorenulls=True).over(w)
    e = e.withColumn("part", part)
    body_line = F.when(~opens | F.col("bound").isNull(), F.struct("line_no", "payload"))
    in_article = e.where("inside").groupBy("doc", "article_no").agg(
        F.max("number").alias("number"), F.max("style").alias("style"), F.max_by("part", F.when(opens, 1)).alias("part"), F.max(F.when(F.col("style") == "plain", plain["annex"])).alias("annex"), F.sort_array(F.collect_list(body_line)).alias("lines")
    )
    path = F.concat_ws(" — ", F.col("part"), F.col("annex"))
    out = in_article.select("doc", "article_no", "number", "style", path.alias("path"), F.concat_ws("\n", F.transform("lines", lambda x: x["payload"])).alias("body"))
    none = e.join(out.select("doc").distinct(), "doc", "left_anti").groupBy("doc").agg(F.sort_array(F.collect_list(F.when(kind == "line", F.struct("line_no", "payload")))).alias("lines"))
    whole = none.select("doc", F.lit(1).cast("long").alias("article_no"), F.lit("unico").alias("number"), F.lit("none").alias("style"), F.lit("").alias("path"), F.concat_ws("\n", F.transform("lines", lambda x: x["payload"])).alias("body"))
    return out.unionByName(whole)


def suffix_rank(suffix: Column) -> Column:
    return F.when(suffix == "", 0).otherwise(F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix)).cast("int")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc, paragraph_no, number, first_line, n_lines): a numbered line opens a paragraph if its number is above all before.

    Accepted numbers rise and rejected ones never pass the running maximum, so accepting is comparing with the
    maximum of all numbers above: a window, not a fold. Lines before the first are a paragraph without number.
    """
    base, suffix = F.regexp_extract("line", PARAGRAPH, 1), F.regexp_extract("line", PARAGRAPH, 2)
    key = F.when(base != "", F.struct(F.try_to_number(base, F.lit("9" * 30)).cast("decimal(30,0)").alias("base"), suffix_rank(suffix).alias("rank")))
    w = Window.partitionBy("doc").orderBy("line_no")
    k = rows.withColumn("key", key).withColumn("number", article_number(base, suffix))
    before = F.max("key").over(w.rowsBetween(Window.unboundedPreceding, -1))
    zero = F.struct(F.lit(0).cast("decimal(30,0)").alias("base"), F.lit(0).alias("rank"))
    k = k.withColumn("opens", F.coalesce(F.col("key") > F.coalesce(before, zero), F.lit(False)))
    k = k.withColumn("paragraph_no", F.sum(F.col("opens").cast("int")).over(w))
    return k.groupBy("doc", "paragraph_no").agg(F.max(F.when(F.col("opens"), F.col("number"))).alias("number"), F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def rubrics(rows: DataFrame) -> DataFrame:
    """(doc, rubric): a line in single brackets among the first four non-blank ones, above any numbered line; "((" marks amendments."""
    text = F.trim("line")
    w = Window.partitionBy("doc").orderBy("line_no")
    k = rows.withColumn("text", text).where("text <> ''")
    k = k.withColumn("place", F.row_number().over(w)).withColumn("numbered", F.max(F.col("text").rlike(PARAGRAPH).cast("int")).over(w))
    bare = F.when(F.endswith("text", F.lit(".")), F.substr("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    words = F.substr(bare, F.lit(2), F.length(bare) - 2)
    bracketed = F.startswith(bare, F.lit("(")) & F.endswith(bare, F.lit(")")) & (words != "") & ~F.startswith(words, F.lit("("))
    return k.where((F.col("place") <= 4) & (F.col("numbered") == 0) & bracketed).groupBy("doc").agg(F.min_by(words, "place").alias("rubric"))


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


_NUMBERED = re.compile(PARAGRAPH, re.ASCII)


def bracketed(line: str) -> str | None:
    """The words of a line that is one bracket, with or without a full stop; double brackets mark amendments."""
    line = line.removesuffix(".")
    return line[1:-1] if len(line) > 2 and line[0] == "(" and line[1] != "(" and line[-1] == ")" else None


def finished(style: str | None, body: str | None) -> tuple[str | None, str]:
    """(rubric, body without it) of one article, cut at the first line that is exactly N O T E."""
    lines = (body or "").split("\n")
    bare = [x.strip() for x in lines]
    if "N O T E" in bare:
        lines = lines[: bare.index("N O T E")]
    some = [k for k, x in enumerate(bare[: len(lines)]) if x]
    if style == "atx" and some:
        stop = begin = some[0]
        while stop < len(lines) and bare[stop] and not _NUMBERED.match(lines[stop]):
            stop += 1
        if stop > begin:
            return " ".join(bare[begin:stop]), "\n".join(lines[:begin] + lines[stop:])
    elif style == "plain":
        for k in some[:4]:
            if _NUMBERED.match(bare[k]):
                break
            if words := bracketed(bare[k]):
                return words, "\n".join(lines[:k] + lines[k + 1 :])
    return None, "\n".join(lines)


def finish_articles(arts: DataFrame) -> DataFrame:
    """Articles with rubric, and the body without it and without the lines from the first that is exactly N O T E.

    ATX articles: the first block of non-blank lines, up to a numbered one, joined by spaces. Plain ones: the line in
    single brackets that `rubrics` finds. Others have none. A fold over an article's lines, in Arrow batches.
    """

    @F.arrow_udf("struct<rubric: string, body: string>")
    def run(style: pa.Array, body: pa.Array) -> pa.Array:
        rows = [finished(s, b) for s, b in zip(style.to_pylist(), body.to_pylist(), strict=True)]
        return pa.array([{"rubric": r, "body": b} for r, b in rows], pa.struct([("rubric", pa.string()), ("body", pa.string())]))

    done = arts.withColumn("done", run("style", "body"))
    return done.select("doc", "article_no", "number", "style", "path", "done.rubric", "done.body")


def article_paragraphs(finished: DataFrame, with_articles: bool = False) -> DataFrame:
    """(doc, article_no, rubric, paragraph_no, number, text) of finished articles; blank text above the first number is none,
    an article without numbers is one paragraph. with_articles adds the article's own number, as `article`, and path."""
    key = F.struct("doc", "article_no")
    a = finished.select(key.alias("doc"), "rubric", F.col("number").alias("article"), "path", F.split("body", "\n").alias("x"))
    found = paragraphs(a.select("doc", F.posexplode("x").alias("at", "line")).select("doc", (F.col("at") + 1).cast("long").alias("line_no"), "line"))
    text = F.array_join(F.slice("x", F.col("first_line").cast("int"), F.col("n_lines").cast("int")), "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"(?U)\s+$", "")
    k = a.join(found, "doc").withColumn("text", text).withColumn("any", F.max("number").over(Window.partitionBy("doc")))
    k = k.withColumn("text", F.when(F.col("any").isNull(), _stripped(F.col("text"))).otherwise(F.col("text")))
    k = k.where(F.col("any").isNull() | F.col("number").isNotNull() | (_stripped(F.col("text")) != ""))
    return k.select("doc.doc", "doc.article_no", "rubric", "paragraph_no", "number", "text", *(["article", "path"] if with_articles else []))


def act_heads(events: DataFrame) -> DataFrame:
    """(doc, title, subtitle): the first level-1 heading, and the first level-2 heading after it that is neither a partition
    nor an article; null where there is none."""
    p = F.col("payload")
    other = (F.col("kind") == "h2") & ~p.rlike(_PARTITION) & ~p.rlike(SETEXT) & ~p.rlike(ONLY)
    first = events.groupBy("doc").agg(F.min(F.when(F.col("kind") == "h1", F.col("line_no"))).alias("at"), F.min_by("payload", F.when(F.col("kind") == "h1", F.col("line_no"))).alias("title"))
    later = events.where(other).join(first.select("doc", "at"), "doc").where("line_no > at").groupBy("doc").agg(F.min_by("payload", "line_no").alias("subtitle"))
    return first.join(later, "doc", "left").select("doc", "title", "subtitle")


def orphan_text(events: DataFrame) -> DataFrame:
    """(doc, orphan): plain lines outside any article, joined."""
    w = Window.partitionBy("doc").orderBy("line_no")
    kind = F.col("kind")
    bound = F.when(article_style().isNotNull(), F.lit(True)).when(kind.isin("h1", "atx", "h2"), F.lit(False))
    e = events.withColumn("inside", F.coalesce(F.last(bound, ignorenulls=True).over(w), F.lit(False)))
    some = e.where((kind == "line") & ~F.col("inside")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line_no", "payload"))).alias("lines"))
    return some.select("doc", F.array_join(F.transform("lines", lambda x: x["payload"]), "\n").alias("orphan"))


def cut_notes(rows: DataFrame) -> DataFrame:
    """Lines above the first that is exactly N O T E."""
    w = Window.partitionBy("doc").orderBy("line_no")
    return rows.withColumn("noted", F.max((F.trim("line") == "N O T E").cast("int")).over(w)).where("noted = 0").drop("noted")


#: A census reads headings by its own rules: an ATX heading may have an underline, and any line but blank ones.
_CENSUS_ATX = r"^(#{1,6}) (.+?)\s*$"
_CENSUS_ARTICLE = r"(?i)^Art\.?\s*\d+"


def census_headings(rows: DataFrame) -> DataFrame:
    """(doc, line_no, level, text, setext) of all headings as the census counts them.

    ATX of level 1 to 6; a non-blank line above a run of "=" or of two or more "-" is one of level 1 or 2, unless it is
    such an underline itself. Of underlines in a row every other one counts, from the first on.
    """
    w = Window.partitionBy("doc").orderBy("line_no")
    line = F.col("line")
    level = F.when(line.rlike(r"^=+\s*$"), 1).when(line.rlike(r"^-{2,}\s*$"), 2)
    k = rows.withColumn("level", level).withColumn("atx", F.nullif(F.regexp_extract("line", _CENSUS_ATX, 1), F.lit("")))
    k = k.withColumn("above", F.trim(F.regexp_replace(F.lag("line").over(w), r"\s+", " ")))
    other = F.col("level").isNull()
    k = k.withColumn("run", F.sum(other.cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy("doc", "run").orderBy("line_no"))
    # Place of a line among the underlines that follow one after the other: the first of them counts if what is above it isn't blank.
    k = k.withColumn("place", place - F.when(F.col("run") > 0, 1).otherwise(0))
    first = Window.partitionBy("doc", "run").orderBy("line_no")
    opens = F.first(F.when(~other, F.coalesce(F.col("above"), F.lit("")) != ""), ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    k = k.withColumn("opens", F.coalesce(opens, F.lit(False)))
    under = ~other & F.when(F.col("opens"), F.col("place") % 2 == 1).otherwise(F.col("place") % 2 == 0)
    atx = k.where("atx is not null").select("doc", "line_no", F.length("atx").alias("level"), F.regexp_extract("line", _CENSUS_ATX, 2).alias("text"), F.lit(False).alias("setext"))
    return atx.unionByName(k.where(under & F.col("atx").isNull()).select("doc", "line_no", "level", F.col("above").alias("text"), F.lit(True).alias("setext")))


def census_scan(rows: DataFrame) -> DataFrame:
    """(doc, s1, s2, a1 .. a6, atx_art, setext_art, plain_art, comma_lines) of each document with lines."""
    heads = census_headings(rows)
    article = F.col("text").rlike(_CENSUS_ARTICLE)
    counts = [F.count_if(F.col("setext") & (F.col("level") == k)).alias(f"s{k}") for k in (1, 2)] + [F.count_if(~F.col("setext") & (F.col("level") == k)).alias(f"a{k}") for k in range(1, 7)]
    found = heads.groupBy("doc").agg(*counts, F.count_if(~F.col("setext") & article).alias("atx_art"), F.count_if(F.col("setext") & article).alias("setext_art"))
    plain = rows.groupBy("doc").agg(F.count_if(F.col("line").rlike(r"^\S.*-art\. \d+[a-z .]*$")).alias("plain_art"), F.count_if(F.col("line").rlike(r"^\d+(-[a-z]+)?\. \S")).alias("comma_lines"))
    return plain.join(found, "doc", "left").na.fill(0).select("doc", *(f"s{k}" for k in (1, 2)), *(f"a{k}" for k in range(1, 7)), "atx_art", "setext_art", "plain_art", "comma_lines")

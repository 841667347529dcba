"""Reports: feedback, census, sizes, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import PARTITIONS


def feedback_rates(rows: DataFrame, config: Column) -> DataFrame:
    """Ratings (1, -1) by configuration, and of all (config null): n, and share of 1. Report order is n from the top, then config."""
    return rows.withColumn("config", config).rollup("config").agg(F.count("*").alias("n"), F.count_if(F.col("rating") == 1).alias("up")).withColumn("up_rate", F.round(F.try_divide("up", "n"), 6))


def exclusive_quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles by the exclusive method, truncated to whole numbers, with minimum, maximum and mean.

    With n values the k-th lies at k(n + 1) / 4, between its neighbours in proportion; a single value is all three. Values
    are counted first, so the window has a row for each distinct one of a group, however large the group.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    upto = F.sum("c").over(whole.orderBy("x"))
    ranked = each.select(group, "x", "c", upto.alias("last"), F.sum("c").over(whole).alias("n"))
    holds = lambda at: at.between(F.col("last") - F.col("c") + 1, F.col("last"))
    picks = []
    for k in (1, 2, 3):
        h = k * (F.col("n") + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(h / 4), F.col("n") - 1))
        d = h - 4 * j
        x = F.when(holds(j), F.col("x") * (4 - d)).otherwise(0.0) + F.when(holds(j + 1), F.col("x") * d).otherwise(0.0)
        picks.append(F.when(F.max("n") == 1, F.max("x")).otherwise(F.sum(x) / 4).cast("long").alias(f"q{k}"))
    mean = F.round(F.sum(F.col("x") * F.col("c")) / F.sum("c"), 4)
    return ranked.groupBy(group).agg(F.max("n").cast("long").alias("n"), F.min("x").cast("long").alias("least"), *picks, F.max("x").cast("long").alias("most"), mean.alias("mean"))


def padding(df: DataFrame, group: str, text: str, least: int) -> DataFrame:
    """Files with more than `least` bytes of padding (NUL, space, tab, line ends) at their end, and the bytes, by group."""
    pad = F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[\x00 \t\r\n]+\z", ""))
    return df.select(group, pad.alias("pad")).groupBy(group).agg(F.count_if(F.col("pad") > least).alias("padded"), F.sum(F.when(F.col("pad") > least, F.col("pad")).otherwise(0)).cast("long").alias("padding_bytes"))


def duplicate_census(df: DataFrame, name: str, size: str) -> DataFrame:
    """Names, and (name, size) pairs, that occur more than once: both levels in one grouping."""
    return df.groupingSets([[F.col(name)], [F.col(name), F.col(size)]], F.col(name), F.col(size)).agg(F.count("*").alias("n"), F.grouping(size).alias("by_name")).where("n > 1")


def sample_per_group(df: DataFrame, group: str, key: Column, k: int, seed: int) -> DataFrame:
    """k rows of each group, the same ones at any layout: those of the smallest hash."""
    h = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(group).orderBy(h, key)
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= k)


_DAY = r"\d{4}-\d{2}-\d{2}"
_CODE = r"\d{2,3}[A-Z][0-9A-Z]{4,5}"
#: Shapes of file names, the first that fits counts.
NAME_SHAPES = [
    (rf"^{_DAY}_[0-9A-Z]+_(?:VIGENZA_{_DAY}|ORIGINALE)_V\d+\.md$", "dated_code"),
    (rf"^{_CODE}\.md$", "code"),
    (rf"[. ]{_CODE}(?:_\d+)?\.md$", "title_code"),
    (r"_[0-9a-f]{12}(?:_\d+)?\.md$", "title_hash"),
    (r"_\d+\.md$", "title_numbered"),
]


def filename_class(name: Column) -> Column:
    out = F.lit("title")
    for pattern, kind in reversed(NAME_SHAPES):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def name_census(files: DataFrame, group: str, name: str) -> DataFrame:
    """(group, class, n, examples): file names by their shape, the two first ones of each as examples."""
    each = files.select(group, F.col(name).alias("name"), filename_class(F.col(name)).alias("class"))
    w = Window.partitionBy(group, "class").orderBy("name")
    two = each.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy(group, "class").agg(F.sort_array(F.collect_list("name")).alias("examples"))
    return each.groupBy(group, "class").agg(F.count("*").alias("n")).join(two, [group, "class"])


def is_base64(text: Column) -> Column:
    """A page in base64: its first signs say so, or the first 64 bytes are all of that alphabet."""
    return F.startswith(text, F.lit("PGh0bWw")) | F.substr(text, F.lit(1), F.lit(64)).rlike(r"^[A-Za-z0-9+/=]{64}$")


def format_census(files: DataFrame, scans: DataFrame, group: str, doc: str, text: str) -> DataFrame:
    """By group: files, markdown, base64, front_matter (a first line of three hyphens), no_heading (markdown without any)."""
    heads = scans.select(F.col("doc").alias(doc), sum(F.col(c) for c in ("s1", "s2", *(f"a{k}" for k in range(1, 7)))).alias("heads"))
    b64 = F.coalesce(is_base64(F.col(text)), F.lit(False))
    front = ~F.col("b64") & (F.trim(F.substring_index(F.col(text), "\n", 1)) == "---")
    each = files.withColumn("b64", b64).withColumn("front", front).select(doc, group, "b64", "front").join(heads, doc, "left")
    return each.groupBy(group).agg(F.count("*").alias("files"), F.count_if(~F.col("b64")).alias("markdown"), F.count_if("b64").alias("base64"), F.count_if("front").alias("front_matter"), F.count_if(~F.col("b64") & (F.coalesce("heads", F.lit(0)) == 0)).alias("no_heading"))


def first_distinct(rows: DataFrame, key: str, value: str, order: list[str], most: int) -> DataFrame:
    """(key, examples): the first `most` different values of each key, in order of their first place."""
    seen = rows.groupBy(key, F.col(value).alias("v")).agg(F.min(F.struct(*order)).alias("at"))
    w = Window.partitionBy(key).orderBy("at", "v")
    return seen.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("examples"))


def partition_census(headings: DataFrame) -> DataFrame:
    """(keyword, n, examples): headings that open with a partition's word, with the first three different texts."""
    word = F.upper(F.regexp_extract("text", rf"(?i)^({'|'.join(PARTITIONS)})\b", 1))
    some = headings.withColumn("keyword", word).where("keyword <> ''")
    return some.groupBy("keyword").agg(F.count("*").alias("n")).join(first_distinct(some, "keyword", "text", ["doc", "line_no"], 3), "keyword")


def level_examples(headings: DataFrame) -> DataFrame:
    """(level, examples): the first five different texts of headings of each level."""
    return first_distinct(headings, "level", "text", ["doc", "line_no"], 5)


def unexpected_entries(listing: DataFrame) -> DataFrame:
    """Entries of a folder of collections (collection, name) that are no text files in a collection: hidden ones, other kinds."""
    odd = F.startswith("name", F.lit(".")) | F.startswith("collection", F.lit(".")) | ~F.endswith("name", F.lit(".md"))
    return listing.where(odd).select("collection", "name")


def write_json_report(report: DataFrame, folder: str, name: str, variant: str, stamp: str) -> str:
    """One JSON line for each row, below <name>[-variant]-<stamp>; returns that path."""
    path = f"{folder.rstrip('/')}/{name}{'-' + variant if variant else ''}-{stamp}"
    report.write.mode("overwrite").json(path)
    return path


def markdown_table(report: DataFrame, order: list[Column], most: int = 1000) -> str:
    """A small report as a table of text; a limit of rows is part of the form."""
    rows = report.orderBy(*order).limit(most).collect()
    show = lambda v: ("" if v is None else "; ".join(f"`{x}`" for x in v) if isinstance(v, list) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [report.columns, ["---"] * len(report.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"

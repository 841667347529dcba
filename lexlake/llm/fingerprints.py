"""Canonical exact digests of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_key, texts


def canonical(text: Column) -> Column:
    """Compatibility composition (NFKC), full case folding, composition again, white space to single spaces, none at the ends.

    The Unicode functions are static methods of ICU, which Spark ships; null counts as empty.
    """
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash64 from two seeds, as 32 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)))))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by a key without nulls, (known, id, tie): rows alike in id and text share it."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), text_key("text").alias("tie"), "text")


KEY = ("known", "id", "tie")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fingerprint, class_id (smallest id with the same canonical text, null if all are null).

    Rows are grouped by the wide hash; within a hash that several rows have, bytes are compared: the least and the
    greatest canonical text are summed up before the shuffle, so a group of any size sends a row for each task. Where
    they differ the hash's rows are told apart by the canonical text itself. Null texts are empty ones, and a class with
    them; null ids stay null; repeated rows give a row each; very long texts are hashed whole; an empty table gives no rows; other columns
    play no part.
    """
    rows = _rows(docs, id_col, text_col)
    prints = stored(rows.select(*KEY, digest(canonical(F.col("text"))).alias("fingerprint")))
    return _classes(rows, prints).select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "fingerprint", "class_id")


def _classes(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """known, id, tie, fingerprint, class_id for each row of prints."""
    own_id = F.when(F.col("known"), F.col("id"))
    buckets = prints.groupBy("fingerprint").agg(F.min(own_id).alias("least"), F.count("*").alias("n"))
    shared = prints.join(buckets.where("n > 1").select("fingerprint"), "fingerprint").select(*KEY).distinct()
    canon = rows.join(shared, list(KEY)).select(*KEY, canonical(F.col("text")).alias("canon"))
    compared = canon.groupBy(digest(F.col("canon")).alias("fingerprint")).agg((F.min("canon") == F.max("canon")).alias("equal"))
    unequal = compared.where("not equal").select("fingerprint")
    told = canon.withColumn("fingerprint", digest(F.col("canon"))).join(unequal, "fingerprint")
    apart = told.join(told.groupBy("fingerprint", "canon").agg(F.min(own_id).alias("own_least")), ["fingerprint", "canon"]).select(*KEY, "own_least", F.lit(True).alias("told")).distinct()
    found = prints.join(buckets.select("fingerprint", "least"), "fingerprint")
    return found.join(apart, list(KEY), "left").select(*KEY, "fingerprint", F.when(F.col("told"), F.col("own_least")).otherwise(F.col("least")).alias("class_id"))


def _next_keys(keys: DataFrame) -> DataFrame:
    """Each distinct key with the one after it, by descending id (null last, then by text hash); the first follows the last.

    Ids are dealt into ranges; within a range the next row, at its end the first row of the next range. The
    one window over all ranges has a row for each range.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("known").desc(), F.col("id").desc(), F.col("tie").asc()]
    ranged = stored(keys.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*order)
    me = F.struct(*KEY, "fingerprint")
    heads = ranged.withColumn("row", F.row_number().over(within)).where("row = 1").select("range", me.alias("head"))
    follow = heads.select("range", F.lead("head").over(Window.orderBy("range")).alias("ahead"), F.first("head").over(Window.orderBy("range")).alias("very_first"))
    # A row for each range: at most the number of shuffle partitions.
    linked = ranged.withColumn("after", F.lead(me).over(within)).join(F.broadcast(follow), "range")
    return linked.select(*KEY, "n_chars", F.coalesce("after", "ahead", "very_first").alias("after"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    The edited text has the last third (rounded down) of the code points replaced by as many from the start of
    the next document's text, all if it is shorter. Exact digests are alike (1) or not (0). Null text is empty.
    Of rows that share an id the order is by the text's hash; rows alike in id and text are one document and give a row each.
    A null id comes last in the order of ids and stays null; a table of one document is its own next. Texts of any length are read whole;
    an empty table gives no rows; other columns play no part, whatever their names.
    """
    rows = _rows(docs, id_col, text_col)
    prints = stored(rows.select(*KEY, F.length("text").cast("long").alias("n_chars"), digest(canonical(F.col("text"))).alias("fingerprint")))
    after = stored(_next_keys(prints.dropDuplicates(list(KEY))))
    # The next text's start goes to the document; both joins and the class comparison deal the texts out alike, once.
    asked = after.select(F.col("after.known").alias("known"), F.col("after.id").alias("id"), F.col("after.tie").alias("tie"), F.struct(*KEY).alias("to"), F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    starts = rows.join(asked, list(KEY)).select(F.col("to.known").alias("known"), F.col("to.id").alias("id"), F.col("to.tie").alias("tie"), F.expr("substring(text, 1, cut)").alias("start"))
    starts = starts.groupBy(*KEY).agg(F.first("start").alias("start"))
    classes = _classes(rows, prints.select(*KEY, "fingerprint")).groupBy(*KEY).agg(F.first("class_id").alias("class_id"))
    known = prints.dropDuplicates(list(KEY)).join(after.select(*KEY, F.col("after.fingerprint").alias("next_fingerprint")), list(KEY)).join(classes, list(KEY))
    made = rows.join(known, list(KEY)).join(starts, list(KEY)).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), start)"))
    made = made.select("*", digest(canonical(F.col("edited"))).alias("edited_fingerprint"))
    return made.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"), "class_id",
    )

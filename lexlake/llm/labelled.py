"""A bounded sample of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, rows: Column | None = None) -> DataFrame:
    """At most `most` rows (doc_id, label, text): the labelled ids with the smallest hash, so the same at any layout.

    The bound is the one limit of fitting; scoring covers all rows. Ids without label or text are left out, of
    several labels of an id the smallest counts, of several texts of an id one. `rows` filters the labels.
    The ids go to every task: at most `most` of them, 16 bytes each.
    """
    label = F.col(f"`{label_col}`").cast("int")
    kept = labels.where(label.isNotNull() & F.col("doc_id").isNotNull() & (rows if rows is not None else F.lit(True)))
    ids = kept.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = texts(docs).where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

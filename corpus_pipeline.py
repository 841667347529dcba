"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import near_copies, packing, pii, shared, substrings, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labelled ones among docs, grades as toxic.

    Null and empty texts, and all documents where no label is usable, stay; repeated rows stay or go together.
    """
    model = toxicity.fit_toxicity(docs, toxicity.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.drop_toxic(docs, model)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, null ids last; texts without words are a group."""
    return near_copies.drop_near_copies(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has too, null ids last; null texts stay null, texts of fewer words than a window as they are."""
    return _counted(substrings.remove_repeats(docs))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; null texts stay null, null ids null."""
    return _counted(pii.redact_personal_data(docs))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("substring_dedup", _substring_dedup), ("personal_data", _personal_data), ("packing", _packing)]

#: A fitted model, connected components and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is stored and read again as the next one's input.

    Empty documents give no rows, empty labels reject none. Texts of any length are read whole. Further columns of documents travel through the
    filtering stages unchanged, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir))
    return docs

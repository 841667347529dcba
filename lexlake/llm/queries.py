"""The queries opN_<name> of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, language, media, packing, periodic, pii, quality, simhash, substrings, token_files, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, toxicity.grades_of(table(spark, sf_dir, "labels"))))


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_features(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, manifest, folder, with_ids=False)


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op10_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_main_lorentz_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(table(spark, sf_dir, "documents"))


def op12_elkan_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(table(spark, sf_dir, "embeddings"))


def op13_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.fit_language(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ordinal_toxicity, op2_canonical_digest, op3_relative_lempel_ziv, op4_speculative_bpe, op5_media_columns, op6_token_files, op7_golay_simhash, op8_bradley_terry_quality, op9_sum_of_squares_packing, op10_crf_personal_data, op11_main_lorentz_runs, op12_elkan_vector_codes, op13_subword_language)}
#: Parts with their nearest entry among those of {c}, and the entries as the means of their parts.
_NEAREST = "SELECT vec_id, label, part, any_value(x) AS x, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry)) AS near FROM p JOIN {c} USING (part) GROUP BY 1, 2, 3"
_MEANS = "SELECT part, entry, list(m ORDER BY place) AS c FROM (SELECT part, near[2] AS entry, place, floor(sum(x[place]) / count(*))::BIGINT AS m FROM {a}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS place) GROUP BY ALL) GROUP BY 1, 2"
SQL: dict[str, str] = {
    "op12_elkan_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM k, (SELECT unnest(range(16)) AS part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN s USING (vec_id)), a0 AS MATERIALIZED ({_NEAREST.format(c='c0')}), m0 AS ({_MEANS.format(a='a0')}),
c1 AS MATERIALIZED (SELECT part, entry, coalesce(m0.c, c0.c) AS c FROM c0 LEFT JOIN m0 USING (part, entry)), a1 AS MATERIALIZED ({_NEAREST.format(c='c1')}), m1 AS ({_MEANS.format(a='a1')}),
c2 AS MATERIALIZED (SELECT part, entry, coalesce(m1.c, c1.c) AS c FROM c1 LEFT JOIN m1 USING (part, entry)), a2 AS ({_NEAREST.format(c='c2')}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', near[2]), '' ORDER BY part) AS code, sum(near[1])::BIGINT AS error FROM a2 GROUP BY 1, 2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM r""",
    "op3_relative_lempel_ziv": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
f AS (SELECT h, min((doc_id, s)) AS m FROM win GROUP BY 1),
cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN f USING (h) WHERE (doc_id, s) <> m)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT word.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN cov ON cov.doc_id = word.doc_id AND cov.p = word.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
}

"""Requests checked before anything is done with them: each row gets the first reason against it, null if there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of requests.
MOST_TURNS, MOST_TURN, MOST_QUERY, MOST_HITS = 20, 8000, 2000, 25
MOST_REASON, MOST_ANSWER, MOST_CITATIONS = 2000, 32000, 100


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; a rule that can't be told counts as broken."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules))


def _length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def check_turns(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, n_turns, reason) of (conversation, turn, role, text): each has 1 to MOST_TURNS turns of known roles, none
    empty or above MOST_TURN characters, the last one the user's. One aggregate, no window."""
    size = _length(F.col("text"))
    seen = turns.groupBy(conversation).agg(
        F.count("*").alias("n_turns"), F.min(F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).alias("roles"), F.min(size).alias("least"), F.max(size).alias("most"), F.max_by("role", "turn").alias("last")
    )
    rules = [(F.col("n_turns") <= MOST_TURNS, "too_many_turns"), (F.col("roles"), "unknown_role"), (F.col("least") > 0, "empty_turn"), (F.col("most") <= MOST_TURN, "turn_too_long"), (F.col("last") == "user", "last_turn_not_user")]
    return seen.select(conversation, "n_turns", first_reason(*rules).alias("reason"))


def search_reason(query: Column, k: Column) -> Column:
    """A query has a sign that isn't white space and at most MOST_QUERY characters; k is 1 to MOST_HITS."""
    return first_reason((F.trim(F.regexp_replace(query, r"(?U)\s+", " ")) != "", "blank_query"), (F.length(query) <= MOST_QUERY, "query_too_long"), (k.between(1, MOST_HITS), "k_out_of_range"))


def feedback_reason(rating: Column, reason: Column, question: Column, answer: Column, n_citations: Column) -> Column:
    """A rating is 1 or -1, question and answer are there and bounded, as are the reason and the citations."""
    rules = [
        (rating.isin(1, -1), "rating"), (_length(reason) <= MOST_REASON, "reason_too_long"), (_length(question) > 0, "no_question"), (_length(question) <= MOST_TURN, "question_too_long"),
        (_length(answer) > 0, "no_answer"), (_length(answer) <= MOST_ANSWER, "answer_too_long"), (F.coalesce(n_citations, F.lit(0)) <= MOST_CITATIONS, "too_many_citations"),
    ]
    return first_reason(*rules)


def required_query(query: Column) -> Column:
    """The query; a blank one fails the job that searches for it."""
    blank = F.coalesce(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")), F.lit("")) == ""
    return F.when(blank, F.raise_error(F.lit("a blank query"))).otherwise(query)


def effective_config(configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """configs (any columns, section, model, effort) with model, effort and label as they take effect, and normal_model.

    catalog: (section, model, label, supports_effort, is_default), a row for each model that may be chosen. A model that
    isn't in the catalog falls back to the section's default, which is written as null in normal_model; an effort stays
    only where the model supports it.
    """
    known = catalog.select("section", F.col("model").alias("model"), "label", "supports_effort")
    default = catalog.where("is_default").select("section", F.col("model").alias("d_model"), F.col("label").alias("d_label"), F.col("supports_effort").alias("d_effort"))
    got = configs.join(known, ["section", "model"], "left").join(default, "section", "left")
    chosen = F.col("label").isNotNull()
    supports = F.when(chosen, F.col("supports_effort")).otherwise(F.col("d_effort"))
    others = [c for c in configs.columns if c not in ("section", "model", "effort")]
    model = F.when(chosen, F.col("model")).otherwise(F.col("d_model"))
    return got.select(
        *others, "section", model.alias("model"), F.when(supports, F.col("effort")).alias("effort"), F.coalesce("label", "d_label").alias("label"), F.when(chosen & (F.col("model") != F.col("d_model")), F.col("model")).alias("normal_model")
    )


def config_summary(answer: Column, answer_effort: Column, query: Column, query_effort: Column) -> Column:
    """A configuration on one line: labels, each with its effort if it has one."""
    part = lambda label, effort: F.concat(label, F.coalesce(F.concat(F.lit(" · effort "), effort), F.lit("")))
    return F.concat(part(answer, answer_effort), F.lit(" — QU: "), part(query, query_effort))

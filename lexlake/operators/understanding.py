"""What a model is asked about a conversation, and what stands in for it where there is none or it fails."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of history, and characters of each.
HISTORY, HISTORY_CHARS = 6, 1500


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, history, current) of conversations (conv_id, turn, role, text) with a user turn: the last user turn, and the
    HISTORY turns before it, each on a line with its role and cut at HISTORY_CHARS. History is empty if there is none."""
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("current"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    before = turns.join(last.select("conv_id", "last"), "conv_id").where("turn < last").withColumn("back", F.row_number().over(w)).where(F.col("back") <= HISTORY)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, HISTORY_CHARS))
    lines = before.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    history = F.array_join(F.transform("x", lambda s: s["line"]), "\n")
    return last.join(lines, "conv_id", "left").select("conv_id", F.coalesce(history, F.lit("")).alias("history"), "current")


def understand(turns: DataFrame, model: Callable[[str, str], str] | None = None) -> DataFrame:
    """(conv_id, query, understood): the question to search for, as a model of (history, current turn) puts it. Without a
    model, and where it fails or says nothing, the current turn as it stands."""
    asked = transcripts(turns)
    if model is None:
        return asked.select("conv_id", F.col("current").alias("query"), F.lit(False).alias("understood"))

    @F.arrow_udf("string")
    def ask(history: pa.Array, current: pa.Array) -> pa.Array:
        out = []
        for h, c in zip(history.to_pylist(), current.to_pylist(), strict=True):
            try:
                out.append(model(h or "", c or "") or None)
            except Exception:  # noqa: BLE001  whatever a hosted model does must not stop the search
                out.append(None)
        return pa.array(out, pa.string())

    told = asked.withColumn("told", ask("history", "current"))
    return told.select("conv_id", F.coalesce("told", "current").alias("query"), F.col("told").isNotNull().alias("understood"))

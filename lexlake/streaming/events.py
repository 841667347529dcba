"""Server-sent events: written from parts of an answer, and read back."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("status", "sources", "token", "citation", "done", "error")


class EventReader:
    """Frames of a text/event-stream in pieces of any size; frames of unknown kinds or with broken data are dropped."""

    def __init__(self, held: str = "", kind: str = "message", data: list[str] | None = None):
        self.held, self.kind, self.data = held, kind, data or []

    def feed(self, piece: str) -> Iterator[tuple[str, object]]:
        *lines, self.held = (self.held + piece).split("\n")
        for line in lines:
            line = line.removesuffix("\r")
            if line:
                field, _, value = line.partition(":")
                if field == "event":
                    self.kind = value.removeprefix(" ")
                elif field == "data":
                    self.data.append(value.removeprefix(" "))
                continue
            kind, data, self.kind, self.data = self.kind, self.data, "message", []
            if data and kind in KINDS:
                try:
                    yield kind, json.loads("\n".join(data))
                except ValueError:
                    pass


def frames(kind: Column, data: Column) -> Column:
    """One frame of a text/event-stream."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def turn_events(parts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(stream_id, event_no, event, payload, verified) of answered turns, in the order of the wire: status, sources, then
    each part as a token, a marker with a verdict also as a citation, at the end done.

    parts: (stream_id, seq, kind, payload) from split_streams; verdicts: (stream_id, marker, verified). A marker of another
    form has no verdict and stays plain text. Streams without parts give nothing.
    """
    token = F.struct(F.lit(0).alias("part"), F.lit("token").alias("event"), F.col("payload"), F.lit(None).cast("boolean").alias("verified"))
    cited = F.struct(F.lit(1).alias("part"), F.lit("citation").alias("event"), F.col("payload"), F.col("verified"))
    one = verdicts.groupBy("stream_id", F.col("marker").alias("payload")).agg(F.bool_or("verified").alias("verified")).withColumn("kind", F.lit("marker"))
    both = parts.join(one, ["stream_id", "kind", "payload"], "left")
    body = both.select("stream_id", (F.col("seq") + 2).alias("at"), F.explode(F.when(F.col("verified").isNotNull(), F.array(token, cited)).otherwise(F.array(token))).alias("e"))
    edge = [F.struct(F.lit(k).cast("long").alias("at"), F.struct(F.lit(0).alias("part"), F.lit(name).alias("event"), F.lit("").alias("payload"), F.lit(None).cast("boolean").alias("verified")).alias("e")) for k, name in ((0, "status"), (1, "sources"), (1 << 60, "done"))]
    ends = parts.select("stream_id").distinct().select("stream_id", F.explode(F.array(*edge)).alias("x")).select("stream_id", "x.at", "x.e")
    w = Window.partitionBy("stream_id").orderBy("at", "e.part")
    return body.unionByName(ends).withColumn("event_no", F.row_number().over(w)).select("stream_id", "event_no", "e.event", "e.payload", "e.verified")

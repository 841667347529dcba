"""Event frames and growing texts in pieces: decoded stream by stream, whatever the cuts, from tables and from Spark streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from .events import EventReader
from .markers import segments

FRAMES = "stream_id string, frame_no long, kind string, data string"
SEGMENTS = "stream_id string, seq long, settled array<struct<kind:string,value:string>>, pending string"

#: What a reader keeps between pieces, as text: (its own state, number of rows so far). A step takes it and a piece to rows and what is kept.
Step = Callable[[str, int, int, object], tuple[str, list[tuple]]]


def frame_step(kept: str, count: int, seq: int, piece: bytes | None) -> tuple[str, list[tuple]]:
    """Kept are the bytes of an unfinished line and the lines of an unfinished frame; rows are whole frames of known kinds whose data is JSON."""
    held, kind, data = json.loads(kept) if kept else ("", "message", [])
    *lines, rest = (bytes.fromhex(held) + bytes(piece or b"")).split(b"\n")
    reader = EventReader("", kind, data)
    found = reader.feed("".join(line.decode("utf-8", "replace") + "\n" for line in lines))
    rows = [(count + k, name, json.dumps(value, ensure_ascii=False)) for k, (name, value) in enumerate(found)]
    return json.dumps([rest.hex(), reader.kind, reader.data]), rows


def segment_step(kept: str, count: int, seq: int, piece: str | None) -> tuple[str, list[tuple]]:
    """Kept is the end of the text that might become a marker; a row for each piece: what it has settled, and what is pending after it."""
    parts = segments(kept + (piece or ""))
    pending = parts.pop()[1] if parts and parts[-1][0] == "pending" else ""
    if not pending and parts and parts[-1] == ("text", parts[-1][1]) and parts[-1][1].endswith("["):
        # One bracket may be the first of two.
        pending = "["
        parts[-1] = ("text", parts[-1][1][:-1])
    return pending, [(seq, [{"kind": k, "value": v} for k, v in parts if v], pending)]


def _columns(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.replace("struct<kind:string,value:string>", "").split(", ")]


def _whole(pieces: DataFrame, step: Step, ddl: str) -> DataFrame:
    """Of whole streams (stream_id, seq, piece): a task reads its streams one after the other, in order, and holds what one keeps."""
    names = _columns(ddl)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, kept, count = None, "", 0
        for f in frames:
            out: list[tuple] = []
            for i, seq, piece in zip(f["stream_id"], f["seq"], f["piece"], strict=True):
                if i != stream:
                    stream, kept, count = i, "", 0
                kept, rows = step(kept, count, int(seq), piece)
                count += len(rows)
                out += [(i, *r) for r in rows]
            yield pd.DataFrame(out, columns=names)

    known = pieces.where("stream_id is not null").select("stream_id", "seq", "piece")
    return known.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, ddl)


def _stateful(pieces: DataFrame, step: Step, ddl: str) -> DataFrame:
    """The same of a stream of (stream_id, seq, piece, is_end): its state is what a stream keeps, until its end."""
    names = _columns(ddl)

    def run(key, frames, state):
        kept, count = state.get if state.exists else ("", 0)
        out, ended = [], False
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, piece, end in zip(rows["seq"], rows["piece"], rows["is_end"], strict=True):
            kept, new = step(kept, count, int(seq), piece)
            count += len(new)
            out += [(key[0], *r) for r in new]
            ended |= bool(end)
        if ended:
            state.remove()
        else:
            state.update((kept, count))
        yield pd.DataFrame(out, columns=names)

    return pieces.where("stream_id is not null").groupBy("stream_id").applyInPandasWithState(run, ddl, "kept string, count long", "append", GroupStateTimeout.NoTimeout)


def decoded_frames(pieces: DataFrame) -> DataFrame:
    """(stream_id, frame_no, kind, data) of text/event-streams cut into pieces of bytes anywhere, also within a character: (stream_id, seq, piece).

    data is JSON; frames of unknown kinds or with broken data are dropped, a frame that never ends is none. Null pieces are empty. On a stream pieces also have
    is_end, and come in order from batch to batch.
    """
    return (_stateful if pieces.isStreaming else _whole)(pieces, frame_step, FRAMES)


def growing_segments(pieces: DataFrame) -> DataFrame:
    """(stream_id, seq, settled, pending) for each piece of texts that grow, (stream_id, seq, piece): text and markers that no further piece can change,
    and the end that might become a marker. All settled values and the last pending one make the text. Null pieces are empty."""
    return (_stateful if pieces.isStreaming else _whole)(pieces, segment_step, SEGMENTS)

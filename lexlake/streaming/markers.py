"""Citation markers [[...]] in streams of text pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters of a marker, its brackets included.
LONGEST = 200
_ACT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-")


class MarkerParser:
    """Splits a stream of pieces into text and markers; what it gives, joined, is what it got, byte for byte.

    A last "[" and an open "[[" wait for more, the latter up to LONGEST characters in all: beyond that its "[[" is text
    and the rest is read again. The first "]]" closes a marker.
    """

    def __init__(self, held: str = ""):
        self.held = held

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held += piece
        while True:
            at = self.held.find("[[")
            if at < 0:
                keep = 1 if self.held.endswith("[") else 0
                text, self.held = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
                if text:
                    yield "text", text
                return
            if at:
                yield "text", self.held[:at]
                self.held = self.held[at:]
            end = self.held.find("]]", 2)
            if 0 <= end <= LONGEST - 2:
                yield "marker", self.held[: end + 2]
                self.held = self.held[end + 2 :]
            elif end >= 0 or len(self.held) > LONGEST:
                yield "text", "[["
                self.held = self.held[2:]
            else:
                return

    def finish(self) -> Iterator[tuple[str, str]]:
        held, self.held = self.held, ""
        if held:
            yield "text", held


def parsed_marker(marker: str) -> dict:
    """Act, article and paragraph of a marker, [[act|art.N]] or [[act|art.N|c.M]]; all null if it has another form.

    Further fields after the article are passed over; none may be empty or hold spaces or brackets.
    """
    act, *fields = marker.removeprefix("[[").removesuffix("]]").split("|")
    ok = act and _ACT.issuperset(act) and fields and fields[0].startswith("art.") and len(fields[0]) > 4
    if not ok or not all(f and not any(c.isspace() or c in "[]" for c in f) for f in fields):
        return dict.fromkeys(("act", "article", "comma"))
    comma = fields[1][2:] if len(fields) > 1 and fields[1].startswith("c.") and len(fields[1]) > 2 else None
    return {"act": act, "article": fields[0][4:], "comma": comma}


def marker_acts(text: Column) -> Column:
    """The acts that the markers of a text name, whatever follows the act, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([a-z0-9-]+)[|]"), F.lit(1)))


def _may_become_marker(part: str) -> bool:
    """An open "[[..." that further text could make a marker."""
    body = part[2:].removesuffix("]")
    act, *fields = body.split("|")
    if len(part) > LONGEST or not _ACT.issuperset(act):
        return False
    if fields and not ("art.".startswith(fields[0]) or fields[0].startswith("art.")):
        return False
    shown = [f.removeprefix("art.") if k == 0 and f.startswith("art.") else f for k, f in enumerate(fields)]
    return not any(c.isspace() or c in "[]" for f in shown for c in f) and all(fields[1:-1])


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, value) of a text that may still grow: text, markers of the grammar, and at the end perhaps one pending, which
    might become a marker. Pairs of another form are text, and neighbouring texts are one."""
    out: list[tuple[str, str]] = []

    def add(kind: str, value: str) -> None:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        elif value:
            out.append((kind, value))

    at = 0
    while (start := text.find("[[", at)) >= 0:
        add("text", text[at:start])
        end = text.find("]]", start + 2)
        if end >= 0:
            pair = text[start : end + 2]
            add("marker" if parsed_marker(pair)["act"] else "text", pair)
            at = end + 2
        elif _may_become_marker(text[start:]):
            add("pending", text[start:])
            return out
        else:
            add("text", "[[")
            at = start + 2
    add("text", text[at:])
    return out


OUTPUT = "stream_id string, seq long, kind string, payload string, act string, article string, comma string"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def _rows(stream: str, seq: int, pieces: Iterator[tuple[str, str]]) -> list[tuple]:
    out = []
    for kind, payload in pieces:
        p = parsed_marker(payload) if kind == "marker" else dict.fromkeys(("act", "article", "comma"))
        out.append((stream, seq + len(out), kind, payload, p["act"], p["article"], p["comma"]))
    return out


def split_streams(pieces: DataFrame) -> DataFrame:
    """Of whole streams (stream_id, seq, delta): the parts in order. Batch form of the stateful operator: each task reads
    its streams one after the other, in sorted order, and holds only what waits for more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, parser, seq = None, MarkerParser(), 0
        for f in frames:
            out: list[tuple] = []
            for i, delta in zip(f["stream_id"], f["delta"], strict=True):
                if i != stream:
                    if stream is not None:
                        out += _rows(stream, seq, parser.finish())
                    stream, parser, seq = i, MarkerParser(), 0
                new = _rows(i, seq, parser.feed(delta or ""))
                out += new
                seq += len(new)
            yield pd.DataFrame(out, columns=NAMES)
        if stream is not None:
            yield pd.DataFrame(_rows(stream, seq, parser.finish()), columns=NAMES)

    known = pieces.where("stream_id is not null").select("stream_id", "seq", "delta")
    return known.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, OUTPUT)


def stateful_markers(pieces: DataFrame) -> DataFrame:
    """The same on a stream of (stream_id, seq, delta, is_end): state is the waiting text and the next number."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        held, seq = state.get if state.exists else ("", 0)
        parser, out, ended = MarkerParser(held), [], False
        rows = pd.concat(list(frames)).sort_values("seq")
        for delta, end in zip(rows["delta"], rows["is_end"], strict=True):
            out += _rows(key[0], seq + len(out), parser.feed(delta or ""))
            if end:
                out += _rows(key[0], seq + len(out), parser.finish())
                ended = True
        if ended:
            state.remove()
        else:
            state.update((parser.held, seq + len(out)))
        yield pd.DataFrame(out, columns=NAMES)

    return pieces.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, "held string, seq long", "append", GroupStateTimeout.NoTimeout)

"""Frames and growing texts: any cut of the same bytes gives the same rows, from tables and from streams."""

import json
import random

from lexlake.streaming import frames
from lexlake.streaming.events import EventReader
from lexlake.streaming.markers import segments

WIRE = "".join(f"event: {k}\ndata: {json.dumps({'text': v}, ensure_ascii=False)}\n\n" for k, v in (("status", ""), ("token", "perché è così 🙂"), ("token", "a\nb"), ("citation", "[[x|art.1]]"), ("other", "no"), ("done", "fine"))) + "event: token\ndata: {broken\n\nevent: token\r\ndata: 1\r\n\r\nevent: token\ndata: 2"
TEXT = "Vedi [[legge-1-2000|art.1]] e [[x]] o [ [[Y]] [[legge-1-2000|art.2|c.1]] fine [[dpr-1-1990|ar"


def cut(value, draw):
    at, out = 0, []
    while at < len(value):
        n = draw.choice([1, 2, 3, 7, 40])
        out.append(value[at : at + n])
        at += n
    return out


def test_any_cut_of_a_table(spark):
    draw = random.Random(1)
    rows = [(f"s{i}", k, bytearray(p)) for i in range(30) for k, p in enumerate(cut(WIRE.encode(), draw))] + [("empty", 0, bytearray()), ("null", 0, None), (None, 0, bytearray(b"x"))]
    got = {}
    for r in sorted(frames.decoded_frames(spark.createDataFrame(rows, "stream_id string, seq long, piece binary")).collect(), key=lambda r: (r.stream_id, r.frame_no)):
        got.setdefault(r.stream_id, []).append((r.kind, json.loads(r.data)))
    want = list(EventReader().feed(WIRE))
    assert len(want) == 6 and got == {f"s{i}": want for i in range(30)}


def joined(rows):
    """Parts of all pieces, texts side by side as one, and what is pending at the end."""
    out = []
    for r in rows:
        for kind, value in r.settled:
            if kind == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + value)
            else:
                out.append((kind, value))
    return out, rows[-1].pending


def test_any_cut_of_a_growing_text(spark):
    draw = random.Random(2)
    rows = [(f"s{i}", k, p) for i in range(30) for k, p in enumerate(cut(TEXT, draw))]
    df = spark.createDataFrame(rows, "stream_id string, seq long, piece string")
    by = {}
    for r in sorted(frames.growing_segments(df).collect(), key=lambda r: (r.stream_id, r.seq)):
        by.setdefault(r.stream_id, []).append(r)
    whole = segments(TEXT)
    assert whole[-1][0] == "pending" and sum(k == "marker" for k, _ in whole) == 2
    assert len(by) == 30 and all(joined(x) == (whole[:-1], whole[-1][1]) for x in by.values())
    assert all(len(x) == sum(s == i for s, _, _ in rows) for i, x in by.items())


def test_streams_that_go_on(spark, tmp_path):
    """Pieces of a stream come over several batches and a restart; state goes with its end."""
    draw = random.Random(3)
    schema = "stream_id string, seq long, piece binary, is_end boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = {f"s{i}": cut(WIRE.encode(), draw) for i in range(3)}
    for step in range(3):
        rows = [(i, k, bytearray(p), k == len(x) - 1) for i, x in parts.items() for k, p in enumerate(x) if k * 3 // len(x) == step]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = frames.decoded_frames(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.stream_id, r.frame_no)):
        got.setdefault(r.stream_id, []).append((r.kind, json.loads(r.data)))
    assert got == {i: list(EventReader().feed(WIRE)) for i in parts}

"""Substring dedup by relative Lempel-Ziv parsing: documents as greedy longest matches against earlier texts.

The reference is the corpus itself, indexed in blocks. A text is known to the index by its windows of `window` words,
each filed under its smallest gram of GRAM words (a minimizer: equal windows name the same gram, at the same place), and
a gram's hash says which block holds it. A block keeps the first place of every window and answers each later one with
it; so does a task's own chunk of documents, a block that needs no shuffle. Of these places a document is then parsed:
at each position the longest match that any block offers is the next factor, its end being where no place goes on in
step. Windows that straddle the end of a factor are checked one by one and start the next factor where they are known
too, so that factors cover just the words of repeated windows, all of them.

Four shuffles: sampled grams to the index blocks, which answer which are there more than once; texts (compressed) to
those answers; windows of such grams to their block; texts to the places. Chunks send each gram and window once at
most, and blocks keep only distinct ones while repeats stream through, so a passage that most texts have costs its
block a row for each chunk of CHUNK_CHARS, none of them held. Nothing is stored outside Spark's own shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import batches, pairs, partitions, release_memory, text_key

WINDOW, GRAM = 20, 8
CHUNK_CHARS = 4 << 20
#: Bytes of questions that a block answers together.
FOLD_BYTES = 8 << 20
#: Kinds of rows, in the order in which a task wants them within a bucket.
ANSWER, ASK, TEXT = 0, 1, 2

#: A document: null ids last, then the id, then a hash of the text for rows that share an id.
_KEY = np.dtype([("null", "u1"), ("id", "<i8"), ("tie", "<i8")])
#: A sampled gram of a document.
_GRAM = np.dtype([("gram", "<u8"), ("doc", _KEY), ("place", "<u4")])
#: Windows under one gram of a document: bit k of the mask is the window that starts k words before the gram.
_HELD = np.dtype([("gram", "<u8"), ("window", "<u8"), ("doc", _KEY), ("place", "<u4"), ("offset", "u1")])
#: Windows of a document, and the place in an earlier text where a block has them.
_KNOWN = np.dtype([("doc", _KEY), ("place", "<u4"), ("mask", "<u4"), ("ref", _KEY), ("ref_place", "<u4")])


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _runs(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n words, of the words' hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k, m in enumerate(_odd(n, seed)):
        out += h[k : k + len(out)] * m
    return _mix(out)


class Sampled:
    """Of one text: hash of each window, place of the gram that it names, and that gram's hash."""

    def __init__(self, words: list[bytes], window: int, gram: int):
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        self.windows = _runs(h, window, 1)
        grams = _runs(h, gram, 2)
        wide = window - gram + 1
        self.at = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(1) + np.arange(len(self.windows))
        self.gram = grams[self.at]


def parse(start: np.ndarray, ref: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, ref, start in ref) of a text whose window at start[k] is also at at[k] of ref[k].

    A window may be known at several places. At each position the longest match is taken, of equals that of the
    smallest ref and place; the next factor begins at the first known window that the last one doesn't hold whole.
    """
    if not len(start):
        return []
    step = at - start
    order = np.lexsort((start, step, ref))
    s, d, r = start[order], step[order], ref[order]
    ends = np.append((s[1:] != s[:-1] + 1) | (d[1:] != d[:-1]) | (r[1:] != r[:-1]), True)
    last = s[np.flatnonzero(ends)[np.cumsum(ends) - ends]]
    best = np.lexsort((s + d, r, -last, s))
    best = best[np.append(True, s[best][1:] != s[best][:-1])]
    s, last, r, d = s[best], last[best], r[best], d[best]
    out, k = [], 0
    while k < len(s):
        out.append((int(s[k]), int(last[k] - s[k]) + window, int(r[k]), int(s[k] + d[k])))
        k = int(np.searchsorted(s, last[k], "right"))
    return out


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    i, tie = (np.ascontiguousarray(keys[c]).view("u8") for c in ("id", "tie"))
    return (_mix(_mix(i) ^ tie ^ keys["null"]) % np.uint64(n)).astype(np.int64)


def _sent(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(bucket)) + 1):
        if len(part):
            yield int(bucket[part[0]]), kind, _pack(rows[part[0] : part[-1] + 1])


_PRESS, _LENS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(rows: np.ndarray) -> bytes:
    """By columns, which compress better: documents come in runs."""
    flat: list[bytes] = []

    def columns(x: np.ndarray) -> None:
        if x.dtype.names:
            for name in x.dtype.names:
                columns(x[name])
        else:
            flat.append(np.ascontiguousarray(x).tobytes())

    columns(rows)
    return _PRESS.compress(b"".join(flat))


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw = _LENS.decompress(blob)
    out = np.empty(len(raw) // kind.itemsize, kind)
    at = 0

    def columns(x: np.ndarray) -> None:
        nonlocal at
        if x.dtype.names:
            for name in x.dtype.names:
                columns(x[name])
        else:
            x[:] = np.frombuffer(raw, x.dtype, len(x), at)
            at += x.dtype.itemsize * len(x)

    columns(out)
    return out


class GramBlock:
    """Which grams of a block are there more than once: holds each distinct one, and its place until a second comes."""

    kind = _GRAM

    def __init__(self):
        self.held, self.often = np.zeros(0, _GRAM), np.zeros(0, bool)

    @property
    def nbytes(self) -> int:
        return self.held.nbytes

    def fold(self, rows: np.ndarray) -> np.ndarray:
        """Places now known to be repeated; a place of NOWHERE says that its chunk has the gram several times."""
        every = np.concatenate([self.held, rows])
        often = np.concatenate([self.often, rows["place"] == NOWHERE])
        open_ = ~often
        order = np.argsort(every["gram"], kind="stable")
        every, often, open_ = every[order], often[order], open_[order]
        first = np.flatnonzero(np.append(True, every["gram"][1:] != every["gram"][:-1])) if len(every) else np.zeros(0, np.int64)
        if not len(first):
            return np.zeros(0, _GRAM)
        size = np.diff(np.append(first, len(every)))
        more = np.logical_or.reduceat(often, first) | (size > 1)
        self.held, self.often = every[first], more
        return every[open_ & np.repeat(more, size)]


NOWHERE = (1 << 32) - 1


def later(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: (first of each distinct one, all others with the first one's document and place)."""
    if not len(rows):
        return rows, np.zeros(0, _KNOWN)
    doc = rows["doc"]
    order = np.lexsort((rows["place"].astype(np.int64) - rows["offset"], doc["tie"], doc["id"], doc["null"], rows["gram"], rows["window"]))
    rows = rows[order]
    again = np.append(False, (rows["gram"][1:] == rows["gram"][:-1]) & (rows["window"][1:] == rows["window"][:-1]))
    # A document whose rows came in different chunks sent its windows twice; none is its own earlier place.
    twice = again & np.append(False, (rows["doc"][1:] == rows["doc"][:-1]) & (rows["place"][1:] == rows["place"][:-1]))
    rows, again = rows[~twice], again[~twice]
    first = np.flatnonzero(~again)[np.cumsum(~again) - 1]
    mine, its = rows[again], rows[first[again]]
    return rows[~again], _masks(mine, its)


def _masks(mine: np.ndarray, its: np.ndarray) -> np.ndarray:
    """Windows under one gram with one reference as a mask."""
    if not len(mine):
        return np.zeros(0, _KNOWN)
    out = np.empty(len(mine), _KNOWN)
    out["doc"], out["place"], out["ref"], out["ref_place"] = mine["doc"], mine["place"], its["doc"], its["place"]
    out["mask"] = 1
    whose = out[["doc", "place", "ref", "ref_place"]]
    cols = [out["ref_place"], out["ref"]["tie"], out["ref"]["id"], out["ref"]["null"], out["place"], out["doc"]["tie"], out["doc"]["id"], out["doc"]["null"]]
    order = np.lexsort(cols)
    whose, offset = whose[order], mine["offset"][order]
    new = np.append(True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols]))
    start = np.flatnonzero(new)
    out = out[order][start]
    out["mask"] = np.bitwise_or.reduceat(np.uint32(1) << offset.astype(np.uint32), start)
    return out


class WindowBlock:
    """The first place of every distinct window of a block; all others are answered with an earlier one."""

    kind = _HELD

    def __init__(self):
        self.held = np.zeros(0, _HELD)

    @property
    def nbytes(self) -> int:
        return self.held.nbytes

    def fold(self, rows: np.ndarray) -> np.ndarray:
        self.held, known = later(np.concatenate([self.held, rows]))
        return known


class _Places:
    """Answers of a bucket by document."""

    def __init__(self, blobs: list[bytes], kind: np.dtype):
        rows = np.concatenate([_unpack(b, kind) for b in blobs]) if blobs else np.zeros(0, kind)
        doc = rows["doc"]
        order = np.lexsort((rows["place"], doc["tie"], doc["id"], doc["null"]))
        self.rows = rows[order]
        doc = self.rows["doc"]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        self.range = dict(zip(doc[first].tolist(), zip(first.tolist(), np.append(first[1:], len(doc))[: len(first)].tolist(), strict=True), strict=True))

        self.places: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def get(self, key: tuple) -> np.ndarray:
        a, b = self.range.get(key, (0, 0))
        return self.rows[a:b]

    def _windows(self, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.get(key)
        row, offset = np.nonzero(known["mask"][:, None] >> np.arange(32, dtype=np.uint32) & np.uint32(1))
        start, at = (known[c][row].astype(np.int64) - offset for c in ("place", "ref_place"))
        return start, known["ref"][row], at

    def windows(self, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, ref, start in ref) of a document's known windows. A place that the document's own chunk gave is replaced
        by the one that the index gave for it, so that matches are with the first places of all texts."""
        start, ref, at = self._windows(key)
        refs, which = np.unique(ref, return_inverse=True)
        order = np.argsort(which.reshape(-1), kind="stable")
        ends = np.searchsorted(which.reshape(-1)[order], np.arange(len(refs) + 1))
        for k, its in enumerate(refs.tolist()):
            if its in self.range:
                if its not in self.places:
                    s, r, a = self._windows(its)
                    by = np.argsort(s, kind="stable")
                    self.places[its] = s[by], r[by], a[by]
                s, r, a = self.places[its]
                mine = order[ends[k] : ends[k + 1]]
                hit = np.minimum(np.searchsorted(s, at[mine]), len(s) - 1)
                found = s[hit] == at[mine]
                ref[mine[found]], at[mine[found]] = r[hit[found]], a[hit[found]]
        return start, ref, at


def _key(i: int | None, tie: int) -> tuple:
    return (int(i is None), i or 0, tie)


def _chunks(rows: Iterator[tuple], text_at: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "")
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


#: A factor of a document: (start, words, (null, id, tie) of the earlier text, start there).
Factor = tuple[int, int, tuple, int]


def parsed(docs: DataFrame, keep: list[str], window: int, gram: int, id_col: str, text_col: str, finish: Callable[[list, int | None, str | None, list[bytes], list[Factor]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """finish(kept columns, id, text, words, factors) makes the output rows of each input row."""
    n = partitions(docs)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(keep))).withColumn("_tie", text_key("_text"))
    row_schema = "bucket int, kind byte, blob binary"
    packed = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])

    def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        return batches(rows, packed, 64)

    def block_of(grams: np.ndarray) -> np.ndarray:
        return (grams % np.uint64(n)).astype(np.int64)

    def sample(got):
        def chunk(rows: list[tuple]) -> Iterator[tuple]:
            # Rows alike in id and text are one document, sent once.
            own = {_key(i, tie): t for i, t, tie in rows}
            parts = []
            for key, text in own.items():
                words = split_words(text)
                if len(words) >= window:
                    s = Sampled(words, window, gram)
                    at, first = np.unique(s.at, return_index=True)
                    part = np.empty(len(at), _GRAM)
                    part["gram"], part["doc"], part["place"] = s.gram[first], np.array(key, _KEY), at
                    parts.append(part)
            if parts:
                block = GramBlock()
                repeated = block.fold(np.concatenate(parts))
                yield from _sent(repeated, _bucket(repeated["doc"], n), ANSWER)
                # What the chunk itself repeats is sent without a place: only that it is known.
                once = block.held
                once["place"][block.often] = NOWHERE
                once["doc"][block.often] = np.zeros(1, _KEY)
                yield from _sent(once, block_of(once["gram"]), ASK)

        rows = (r for b in got for r in pairs(b, "_id", "_text", "_tie"))
        yield from out(r for c in _chunks(rows, 1) for r in chunk(c))
        release_memory()

    def blocks(got, kind):
        """Rows come by bucket, answers first: those are handed on; questions are folded into the bucket's block."""

        def rows() -> Iterator[tuple]:
            bucket, block, held, size = None, kind(), [], 0

            def answer() -> Iterator[tuple]:
                if held:
                    known = block.fold(np.concatenate([_unpack(b, kind.kind) for b in held]))
                    yield from _sent(known, _bucket(known["doc"], n), ANSWER)
                    held.clear()

            for batch in got:
                for b, what, blob in pairs(batch, "bucket", "kind", "blob"):
                    if b != bucket:
                        yield from answer()
                        bucket, block, size = b, kind(), 0
                    if what == ANSWER:
                        yield b, what, blob
                        continue
                    held.append(blob)
                    size += len(blob)
                    if size >= max(FOLD_BYTES, block.nbytes // 2):
                        yield from answer()
                        size = 0
            yield from answer()

        yield from out(rows())
        release_memory()

    def documents(got, kind, work):
        """Rows come by bucket, answers before texts: work(answers, texts of the bucket)."""
        bucket, held, found = None, [], None
        lens = zstandard.ZstdDecompressor()
        names = ["bucket", "kind", "blob", "_id", "_tie", *(f"_c{k}" for k in range(len(keep)))]

        for batch in got:
            part: list[tuple] = []
            for r in pairs(batch, *names):
                if r[0] != bucket:
                    if part:
                        yield from work(found, part)
                        part = []
                    bucket, held, found = r[0], [], None
                if r[1] == ANSWER:
                    held.append(r[2])
                    continue
                if found is None:
                    found, held = _Places(held, kind), []
                part.append((lens.decompress(r[2]).decode("utf-8") if r[2] is not None else None, *r[3:]))
            if part:
                yield from work(found, part)
        release_memory()

    def windows(got):
        def work(found: _Places, rows: list[tuple]):
            for some in _chunks(iter(rows), 0):
                yield from out(chunk(found, some))

        def chunk(found: _Places, rows: list[tuple]) -> Iterator[tuple]:
            own = {_key(r[1], r[2]): r[0] for r in rows}
            parts = []
            for key, text in own.items():
                place = found.get(key)["place"]
                if len(place):
                    s = Sampled(split_words(text), window, gram)
                    some = np.flatnonzero(np.isin(s.at, place))
                    part = np.empty(len(some), _HELD)
                    part["gram"], part["window"], part["doc"], part["place"], part["offset"] = s.gram[some], s.windows[some], np.array(key, _KEY), s.at[some], s.at[some] - some
                    parts.append(part)
            if parts:
                first, known = later(np.concatenate(parts))
                yield from _sent(known, _bucket(known["doc"], n), ANSWER)
                yield from _sent(first, block_of(first["gram"]), ASK)

        yield from documents(got, _GRAM, work)

    arrow_out = to_arrow_schema(schema)

    def result(got):
        def made(found: _Places, rows: list[tuple]) -> Iterator[tuple]:
            for text, i, tie, *kept in rows:
                key = _key(i, tie)
                factors: list[Factor] = []
                if key in found.range:
                    start, ref, at = found.windows(key)
                    refs, ref = np.unique(ref, return_inverse=True)
                    factors = [(s, k, refs[r].item(), a) for s, k, r, a in parse(start, ref.reshape(-1), at, window)]
                yield from finish(kept, i, text, split_words(text), factors)

        yield from documents(got, _KNOWN, lambda found, rows: batches(made(found, rows), arrow_out, 2048))

    def compressed(got):
        press = zstandard.ZstdCompressor(level=3)
        for batch in got:
            id_, text, tie = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_text", "_tie"))
            keys = np.array([_key(i, t) for i, t in zip(id_.to_pylist(), tie.to_pylist(), strict=True)], _KEY)
            blobs = [None if t is None else press.compress(t.encode("utf-8", "replace")) for t in text.to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(f"_c{k}")) for k in range(len(keep))]
            cols = [pa.array(_bucket(keys, n).astype(np.int32)), pa.array(np.full(len(keys), TEXT, np.int8)), pa.array(blobs, pa.binary()), id_, tie, *kept]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "kind", "blob", "_id", "_tie", *(f"_c{k}" for k in range(len(keep)))])

    extra = [T.StructField("_id", T.LongType()), T.StructField("_tie", T.LongType()), *(T.StructField(f"_c{k}", docs.schema[c].dataType) for k, c in enumerate(keep))]
    text_schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.ByteType()), T.StructField("blob", T.BinaryType()), *extra])
    texts_ = base.mapInArrow(compressed, text_schema)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    def with_texts(answers: DataFrame) -> DataFrame:
        return dealt(answers.select("bucket", "kind", "blob", *(F.lit(None).cast(f.dataType).alias(f.name) for f in extra)).union(texts_))

    places = dealt(base.select("_id", "_text", "_tie").mapInArrow(sample, row_schema)).mapInArrow(lambda got: blocks(got, GramBlock), row_schema)
    asked = with_texts(places).mapInArrow(windows, row_schema)
    known = dealt(asked).mapInArrow(lambda got: blocks(got, WindowBlock), row_schema)
    return with_texts(known).mapInArrow(result, schema)


def covered(n: int, factors: list[Factor]) -> np.ndarray:
    """Which of n words lie in a factor."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, _, _ in factors:
        edge[start] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def kept_text(text: str, words: list[bytes], gone: np.ndarray) -> str:
    """The text without the words that are gone and the white space after each; unchanged if none is."""
    if not gone.any():
        return text
    raw, at, out = text.encode("utf-8", "replace"), 0, []
    starts = []
    for w in words:
        at = raw.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(raw))
    begin = 0
    for k in np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist():
        out.append(raw[begin : starts[k[0]]])
        begin = starts[k[1]]
    return b"".join([*out, raw[begin:]]).decode("utf-8", "replace")


def relative_factors(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each factor of at least `window` words: doc_id, start, n_words, ref_doc_id, ref_start (in words).

    The factor's words stand at ref_start of the earlier text ref_doc_id, or earlier in the same text, which it may
    overlap. Documents are ordered by id, null ids last, then by their text's hash; of rows alike in id and text, one
    document, each has its factors. Null, empty and short texts and texts without repeats have none; an empty table
    gives no rows. Very long texts are parsed whole. Of places that match as long the one of the smallest ref and place is given. Other columns
    play no part, whatever their names.
    """

    def finish(kept, i, text, words, factors):
        return ((i, start, n, None if ref[0] else ref[1], at) for start, n, ref, at in factors)

    return parsed(docs, [], window, GRAM, id_col, text_col, finish, T.StructType.fromDDL("doc_id long, start long, n_words long, ref_doc_id long, ref_start long"))


def dedup_digest(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    Words are runs without ASCII white space. A word is removed if a factor covers it, that is if a window of
    `window` words that has it starts earlier too: in a smaller id or earlier in its text. Null ids come last; rows
    that share an id go by their text's hash; rows alike in id and text are one document, all with its result. Null
    text has no words; texts shorter than a window lose none; an empty table gives no rows.
    """

    def finish(kept, i, text, words, factors):
        gone = covered(len(words), factors)
        left = [w for w, c in zip(words, gone.tolist(), strict=True) if not c] if factors else words
        yield i, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    return parsed(docs, [], window, GRAM, id_col, text_col, finish, T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with the words of factors taken out of the text, and the white space after each.

    Null texts stay null, empty and unrepeated ones are unchanged, very long ones are read whole. Ties go by the order
    of dedup_digest, repeated rows are one document and stay, each cut alike; an empty table stays empty. Other columns
    are carried under inner names, so that theirs may be any.
    """
    names = docs.columns
    at = names.index(text_col)
    others = [c for c in names if c != text_col]

    def finish(kept, i, text, words, factors):
        row = list(kept)
        row.insert(at, None if text is None else kept_text(text, words, covered(len(words), factors)))
        yield tuple(row)

    return parsed(docs, others, window, GRAM, id_col, text_col, finish, docs.schema)

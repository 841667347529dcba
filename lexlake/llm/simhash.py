"""SimHash near-duplicates: fingerprints of word shingles, linked through Golay-code keys.

The (23, 12) Golay code is perfect: each 23-bit word is within 3 bits of one codeword. A word and one that differs
from it in one bit therefore share a codeword index, if one side takes the indices of all its one-bit neighbours
too (6 of them at most). A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Three differing bits leave
either two segments equal or one equal and one with a single difference, or one difference in each; so two
fingerprints within 3 bits share one of these keys: a segment's own bits with another's codeword index (six
ordered choices), or the codeword indices of all three segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import batches, pairs, partitions, release_memory, stored, texts

RADIUS = 3
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
CUTS = ((0, 22), (22, 21), (43, 21))
ORDERED = [(a, b) for a in range(3) for b in range(3) if a != b]
#: Rows of one key that one task compares with one block of as many; hot keys are cut into blocks of this size.
BLOCK = 4096
MOST_HOT = 2000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles, repeats included: A-Z lower-cased, words split at ASCII white space. A shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")


def print_of(h: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def shingle_fingerprint(text: str | None, width: int = 3) -> int:
    """0 for a text without words."""
    return print_of(shingle_hashes(text, width))


def signed(x: int) -> int:
    """64 bits as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


class Golay:
    """Decoding by syndromes: the remainder of a word by the generator tells the pattern of at most 3 wrong bits."""

    def __init__(self):
        rest = [self._remainder(1 << k) for k in range(23)]
        self.low, self.high = (np.array([self._xor(rest[at : at + 12], w) for w in range(1 << 12)], np.uint32) for at in (0, 12))
        self.wrong = np.zeros(1 << 11, np.uint32)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    e = (1 << a) | (1 << b) | (1 << c)
                    self.wrong[rest[a] if a == b == c else self._xor([rest[k] for k in {a, b, c}], -1)] = e

    @staticmethod
    def _remainder(w: int) -> int:
        for k in range(22, 10, -1):
            if w >> k & 1:
                w ^= GENERATOR << (k - 11)
        return w

    @staticmethod
    def _xor(parts: list[int], chosen: int) -> int:
        out = 0
        for k, p in enumerate(parts):
            if chosen >> k & 1:
                out ^= p
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        """The number (12 bits) of the nearest codeword."""
        w = words.astype(np.uint32)
        return ((w ^ self.wrong[self.low[w & 0xFFF] ^ self.high[w >> 12]]) >> 11).astype(np.uint64)


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, bits = CUTS[k]
    return (fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)


def golay_keys(fp: np.ndarray, code: Golay) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(position of the fingerprint, key, role): role 0 are keys to be found by, 1 keys to look for. Two fingerprints
    within RADIUS bits share a key in different roles, whichever of them looks."""
    n, at = len(fp), np.arange(len(fp))
    part = [segment(fp, k) for k in range(3)]
    own = [code.index(p) for p in part]
    near = []
    for k, (_, bits) in enumerate(CUTS):
        around = np.stack([own[k], *(code.index(part[k] ^ np.uint64(1 << j)) for j in range(bits))], axis=1)
        around.sort(axis=1)
        fresh = np.ones_like(around, bool)
        fresh[:, 1:] = around[:, 1:] != around[:, :-1]
        row, col = np.nonzero(fresh)
        near.append((row, around[row, col]))
    for tag, (a, b) in enumerate(ORDERED):
        head = (np.uint64(tag) << np.uint64(40)) | (part[a] << np.uint64(12))
        yield at, head | own[b], 0
        row, idx = near[b]
        yield row, head[row] | idx, 1
    # One difference in each segment: the first and the last segment's neighbours are looked for, the middle one's are found by.
    tag = np.uint64(len(ORDERED)) << np.uint64(40)
    row, idx = near[1]
    yield row, tag | (own[0][row] << np.uint64(24)) | (idx << np.uint64(12)) | own[2][row], 0
    (r0, i0), (r2, i2) = near[0], near[2]
    first = np.searchsorted(r2, np.arange(n + 1))
    count = np.diff(first)[r0]
    row = np.repeat(r0, count)
    other = i2[np.repeat(first[r0], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    yield row, tag | (np.repeat(i0, count) << np.uint64(24)) | (own[1][row] << np.uint64(12)) | other, 1


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints, broadcast against each other."""
    return np.bitwise_count(a ^ b)[..., 0] <= RADIUS


def node_ids(prints: np.ndarray) -> np.ndarray:
    """A node for each fingerprint: itself, or 64 bits of several columns."""
    out = prints[:, 0].copy()
    for k in range(1, prints.shape[1]):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + prints[:, k] * np.uint64(0x9E3779B97F4A7C15)
    return out


class Union:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def forest(prints: np.ndarray, role: np.ndarray) -> np.ndarray:
    """Links between the fingerprints of one key that keep all its connections: fewer than it has fingerprints."""
    nodes, at, where = np.unique(prints, axis=0, return_index=True, return_inverse=True)
    where = where.reshape(-1)
    f, q = np.unique(where[role == 0]), np.unique(where[role == 1])
    ids = node_ids(nodes)
    sets, links = Union(len(nodes)), []
    label = np.arange(len(nodes))
    for k in range(0, len(q), 256):
        part = q[k : k + 256]
        x, y = np.nonzero(close(nodes[part][:, None, :], nodes[f][None, :, :]))
        x, y = part[x], f[y]
        open_ = label[x] != label[y]
        if not open_.any():
            continue
        pair = np.unique(np.stack([label[x[open_]], label[y[open_]]], axis=1), axis=0)
        for a, b in pair.tolist():
            ra, rb = sets.root(a), sets.root(b)
            if ra != rb:
                # The roots stand for two groups that the pair joins; a link between roots joins them as well.
                sets.up[max(ra, rb)] = min(ra, rb)
                links.append((ids[max(ra, rb)], ids[min(ra, rb)]))
        label = np.array([sets.root(i) for i in label])
    return np.array(links, np.uint64).reshape(-1, 2)


_HOT = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("n", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _numbers(batch: pa.RecordBatch, k: int, kind: str = "u8") -> np.ndarray:
    got = batch.column(k).to_numpy(zero_copy_only=False)
    return got.view("u8") if kind == "u8" else got


def _prints(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([_numbers(batch, k) for k in range(first, batch.num_columns)], axis=1)


def hot_keys(fps: DataFrame, keys) -> dict[tuple[int, int], int]:
    """Keys that hold many of all rows, with how many blocks they are cut into: MOST_HOT at most, the bound of what is sent to tasks.

    Each task names only keys with a share of its own rows that a hot key has; missing one costs balance, never links.
    """

    def run(got):
        code, held, rows = Golay(), {}, 0
        for batch in got:
            for _, key, role in keys(_numbers(batch, 0), code):
                rows += len(key)
                k, n = np.unique(key, return_counts=True)
                for x, c in zip(k[n > 16].tolist(), n[n > 16].tolist(), strict=True):
                    held[x, role] = held.get((x, role), 0) + c
        least = rows // (4 * MOST_HOT)
        yield from batches(((k, r, n) for (k, r), n in held.items() if n >= least), _HOT)

    rows = fps.mapInArrow(run, "key long, role byte, n long").groupBy("key", "role").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).orderBy(F.desc("n")).limit(MOST_HOT).collect()
    return {(r.key, r.role): -(-r.n // BLOCK) for r in rows}


def near_links(fps: DataFrame, keys=golay_keys) -> DataFrame:
    """Of distinct fingerprints: links (a, b) of nodes that connect all close ones, and only such.

    A group of n fingerprints under one key gives less than n links, not all its pairs. A hot key is cut into
    blocks on both sides; a task compares two blocks.
    """
    hot = hot_keys(fps, keys)
    n = partitions(fps)
    cols = [f"p{k}" for k in range(len(fps.columns))]
    schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("role", pa.int8()), *((c, pa.int64()) for c in cols)])

    def row_batch(key: np.ndarray, block: np.ndarray, role: int, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(block), pa.array(np.full(len(key), role, np.int8)), *(pa.array(np.ascontiguousarray(prints[:, k]).view("i8")) for k in range(len(cols)))], schema=schema)

    def keyed(got):
        code = Golay()
        for batch in got:
            all_prints = _prints(batch, 0)
            for begin in range(0, len(all_prints), 2048):
                prints = all_prints[begin : begin + 2048]
                for at, key, role in keys(prints[:, 0], code):
                    block = np.zeros(len(key), np.int32)
                    some = np.flatnonzero(np.isin(key, np.array([k for k, _ in hot], np.int64).view("u8"))) if hot else np.zeros(0, np.int64)
                    for k in np.unique(key[some]).tolist():
                        mine = some[key[some] == k]
                        row = prints[at[mine]]
                        own = node_ids(row) % np.uint64(1000003)
                        name = signed(k)
                        ours, theirs = hot.get((name, role), 1), hot.get((name, 1 - role), 1)
                        # Block number: found-by block x looking blocks + looking block.
                        step, other = (theirs, 1) if role == 0 else (1, ours)
                        base = (own % np.uint64(ours)).astype(np.int32) * np.int32(step)
                        block[mine] = base
                        for j in range(1, theirs):
                            yield row_batch(key[mine], base + np.int32(j * other), role, row)
                    yield row_batch(key, block, role, prints[at])
        release_memory()

    def linked(got):
        held = None
        for batch in got:
            new = (_numbers(batch, 0), _numbers(batch, 1, ""), _numbers(batch, 2, ""), _prints(batch, 3))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            last = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(last):
                yield from _links_of(*(h[: last[-1] + 1] for h in held))
                held = tuple(h[last[-1] + 1 :] for h in held)
        if held is not None:
            yield from _links_of(*held)
        release_memory()

    ddl = ", ".join(f"{c} long" for c in cols)
    rows = fps.mapInArrow(keyed, f"key long, block int, role byte, {ddl}")
    return rows.repartition(n, "key", "block").sortWithinPartitions("key", "block").mapInArrow(linked, "a long, b long").distinct()


def _links_of(key: np.ndarray, block: np.ndarray, role: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted by key and block; whole groups."""
    if not len(key):
        return
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
    size = np.diff(np.append(start, len(key)))
    both = (np.add.reduceat((role == 0).astype(np.int64), start) > 0) & (np.add.reduceat((role == 1).astype(np.int64), start) > 0)
    small = both & (size <= 32)
    out = []
    if small.any():
        # All pairs of the small groups at once: each row against those up to 31 places on.
        group = np.repeat(np.arange(len(start)), size)
        on = np.flatnonzero(np.repeat(small, size))
        for lag in range(1, int(size[small].max())):
            on = on[on + lag < len(key)]
            on = on[group[on] == group[on + lag]]
            x, y = on, on + lag
            some = role[x] != role[y]
            x, y = x[some], y[some]
            some = close(prints[x], prints[y]) & (prints[x] != prints[y]).any(1)
            out.append(np.stack([node_ids(prints[x[some]]), node_ids(prints[y[some]])], axis=1))
    for g in np.flatnonzero(both & (size > 32)):
        part = slice(start[g], start[g] + size[g])
        out.append(forest(prints[part], role[part]))
    links = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
    if len(links):
        links = np.unique(links, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, k].copy().view("i8")) for k in range(2)], schema=_LINK)


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), one row for each input row; null and wordless texts have 0."""

    def run(got):
        for batch in got:
            yield from batches(((i, signed(shingle_fingerprint(t, width))) for i, t in pairs(batch, "doc_id", "text")), _PRINTS)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of RADIUS or fewer differing bits are linked; component_id is the smallest id reachable, the
    row's own included. Equal fingerprints are one node, so a group of copies is one, however large. A null id
    takes part and is never the smallest (null only if nothing else is reachable); repeated rows give a row each. A null, empty or
    wordless text has fingerprint zero and is linked like any other; a bit set in just half of the shingles is 0; very long texts are read
    whole; an empty table gives no rows; other columns play no part.
    """
    prints = stored(fingerprints(docs, width, id_col, text_col))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("fp")))
    known = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(classes, "root").select(F.col("fp").alias("known"), "component_id")
    return prints.join(named, prints.fp == named.known).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

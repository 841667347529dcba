"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, each pair checked exactly.

Candidates come from two indexes. The SimHash prints of the shingles meet under their Golay keys (simhash.py), which
finds prints that differ in RADIUS bits or fewer; texts of a similarity near 0.8 differ in some ten of 64 bits, where no
such keys of a useful width meet. Those meet under keys of ROWS minima of the sets each, of which there are BANDS: two sets
of similarity s share one with a probability of 1 - (1 - s**ROWS)**BANDS, which at 0.8 leaves out 6 pairs in ten
million, and less above. Sketches (shingles counted by the last bits of their hashes) then rule most others out, and the
sets themselves decide. Rounds of this go on until no candidate is left that isn't refuted or already connected, so
that a group of near copies costs each member a few checks, not one with every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import batches, pairs, partitions, release_memory, stored, stored_with, text_key, texts

WIDTH = 5
BANDS, ROWS = 36, 5
#: Counts of a first sketch, and of the finer one that later rounds compare.
COUNTS, FINE = 128, 1024
#: Candidates that a set may check in a round: this to the power of rounds before.
GROWTH = 4

_A, _B = (np.random.default_rng(11 + k).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in range(2))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; A-Z lower-cased, words split at ASCII white space. A shorter text is one shingle."""
    return np.unique(simhash.shingle_hashes(text, WIDTH))


def set_node(h: np.ndarray) -> int:
    """64 bits, as Spark's long, that stand for the set; texts with equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band: ROWS minima of the set, each under its own order. No keys for an empty set."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (h[k : k + 4096, None] * _A + _B).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + row
    return (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def counts(h: np.ndarray, n: int = COUNTS) -> bytes:
    """Shingles by the last bits of their hash, modulo 256."""
    return np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8).tobytes()


def may_be_near(size: np.ndarray | int, count: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """False only where a similarity of 0.8 or more is impossible: two such sets of a and b shingles differ in (a + b) / 9
    at most, and their counts by no more. Differences modulo 256 are never above the true ones."""
    least = np.abs((counts - count).view(np.int8).astype(np.int16)).sum(1)
    return (9 * least <= sizes + size) & (5 * sizes >= 4 * size) & (5 * size >= 4 * sizes)


def near(common, a, b):
    """A Jaccard similarity of 0.8 or more, of numbers or columns."""
    return 9 * common >= 4 * (a + b)


_DOCS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64()))])
_KEYED = pa.schema([("key", pa.int64()), ("node", pa.int64())])
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_KEYED_LINK = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
_SET = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64())), ("fine", pa.binary())])


def described(read: DataFrame) -> DataFrame:
    """Of (doc_id, text, tie): doc_id, tie, node, size, fp, counts, keys; a task gives a node's keys once."""

    def run(got):
        seen = set()
        for batch in got:
            def rows(batch=batch):
                for i, text, tie in pairs(batch, "doc_id", "text", "tie"):
                    every = simhash.shingle_hashes(text, WIDTH)
                    h = np.unique(every)
                    node = set_node(h)
                    new = node not in seen
                    seen.add(node)
                    yield i, tie, node, len(h), simhash.signed(simhash.print_of(every)), counts(h) if new else b"", band_keys(h).view("i8") if new else []

            yield from batches(rows(), _DOCS, 512)
        release_memory()

    return read.mapInArrow(run, "doc_id long, tie long, node long, size long, fp long, counts binary, keys array<long>")


def _numbers(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) of the keys that several nodes have; only a key's last node is held at a time."""

    def run(got):
        held = (None, None, False)  # key, node, sent
        for batch in got:
            if not batch.num_rows:
                continue
            key, node = _numbers(batch, 0), _numbers(batch, 1)
            if held[0] is not None:
                key, node = np.append(held[0], key), np.append(held[1], node)
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node = key[new], node[new]
            same = key[1:] == key[:-1]
            some = np.append(False, same) | np.append(same, False)
            was_sent = held[0] is not None and held[2]
            out = some.copy()
            out[-1] = len(key) > 1 and some[-1]
            if was_sent:
                out[0] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], schema=_KEYED)
            held = (key[-1], node[-1], bool(some[-1]) or (len(key) == 1 and was_sent))
        release_memory()

    n = partitions(nodes)
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition(n, "key").sortWithinPartitions("key", "node")
    return keyed.mapInArrow(run, "key long, node long")


def _counted(batch: pa.RecordBatch, k: int, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n)


def _out(links: set[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=schema)


def _groups(got: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(key, whether it goes on from the batch before, rows of that key): batches are sorted by key, groups may span them."""
    last = None
    for batch in got:
        if not batch.num_rows:
            continue
        key = _numbers(batch, 0)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
            yield int(key[a]), int(key[a]) == last, batch.slice(a, b - a)
            last = int(key[a])


def first_links(rows: DataFrame) -> DataFrame:
    """Of (key, node, size, counts): each node with the first ones of its key that it may be near. A node that has none
    is one of those; a task holds only them."""

    def run(got):
        links: set[tuple[int, int]] = set()
        nodes, sizes, marks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, COUNTS), np.uint8)
        for _, goes_on, part in _groups(got):
            if not goes_on:
                nodes, sizes, marks = nodes[:0], sizes[:0], marks[:0]
            new, size, mark = _numbers(part, 1), _numbers(part, 2), _counted(part, 3, COUNTS)
            left = np.ones(len(new), bool)
            for k in range(len(nodes)):
                some = may_be_near(sizes[k], marks[k], size, mark)
                links.update((max(x, int(nodes[k])), min(x, int(nodes[k]))) for x in new[some].tolist())
                left &= ~some
            while left.any():
                k = int(np.argmax(left))
                some = may_be_near(size[k], mark[k], size, mark)
                some[k] = False
                some &= left
                links.update((max(x, int(new[k])), min(x, int(new[k]))) for x in new[some].tolist())
                left &= ~some
                left[k] = False
                nodes, sizes, marks = np.append(nodes, new[k]), np.append(sizes, size[k]), np.vstack([marks, mark[k]])
            if len(links) >= 1 << 16:
                yield from _out(links, _LINK)
                links = set()
        yield from _out(links, _LINK)
        release_memory()

    n = partitions(rows)
    return rows.select("key", "node", "size", "counts").repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long")


def further_links(rows: DataFrame) -> DataFrame:
    """Of (key, big, node, root, size, tried, fine): (key, u, v), nodes of different roots under a key that may be near.

    big marks the rows of the key's largest class; u is always of another. A node of those asks for one more than it has
    `tried` without success, in its life: if any other candidate is left under the key, one of these is new. So what a
    class of any size gets is a few rows for each node outside of it, and a node without a new one has none left there,
    now or later. A task holds those nodes.
    """

    def run(got):
        links: set[tuple[int, int, int]] = set()
        nodes = roots = sizes = left = marks = np.zeros(0, np.int64)
        for key, goes_on, part in _groups(got):
            big = part.column(1).to_numpy(zero_copy_only=False)
            new, root, size, more = (_numbers(part, k) for k in (2, 3, 4, 5))
            mark = _counted(part, 6, FINE)
            if not goes_on:
                nodes, roots, sizes, left, marks = new[:0], root[:0], size[:0], more[:0].copy(), mark[:0]
            at, small = len(nodes), ~big
            if small.any():
                nodes, roots, sizes, left, marks = (np.concatenate(x) for x in ((nodes, new[small]), (roots, root[small]), (sizes, size[small]), (left, more[small] + 1), (marks, mark[small])))
                for k in range(at, len(nodes)):
                    both = np.flatnonzero(may_be_near(sizes[k], marks[k], sizes[:k], marks[:k]) & (roots[:k] != roots[k]))
                    some, asks = both[: left[k]], both[left[both] > 0]
                    links.update((key, int(nodes[k]), x) for x in nodes[some].tolist())
                    links.update((key, x, int(nodes[k])) for x in nodes[asks].tolist())
                    left[k] -= len(some)
                    left[asks] -= 1
            if big.any():
                v, its, sketch, root_ = new[big], size[big], mark[big], root[big]
                for k in np.flatnonzero(left > 0).tolist():
                    some = np.flatnonzero(may_be_near(sizes[k], marks[k], its, sketch) & (root_ != roots[k]))[: left[k]]
                    links.update((key, int(nodes[k]), x) for x in v[some].tolist())
                    left[k] -= len(some)
            if len(links) >= 1 << 16:
                yield from _out(links, _KEYED_LINK)
                links = set()
        yield from _out(links, _KEYED_LINK)
        release_memory()

    n = partitions(rows)
    return rows.select("key", "big", "node", "root", "size", "tried", "fine").repartition(n, "key").sortWithinPartitions("key", "big", "node").mapInArrow(run, "key long, u long, v long")


def print_links(nodes: DataFrame) -> DataFrame:
    """Links between nodes whose SimHash prints are equal or have a Golay key in common and differ in RADIUS bits or fewer."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    close = simhash.near_links(first.select("fp"))
    a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("u")), first.select(F.col("fp").alias("b"), F.col("first").alias("v"))
    return same.union(close.join(a, "a").join(b, "b").select("u", "v"))


def _checked(links: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """(u, v, near) of the `most` candidates of each u with the smallest v; u is the node that looks for a partner."""
    if most == 1:
        pair = links.groupBy("u").agg(F.min("v").alias("v"))
    else:
        pair = links.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("v"))).where(F.col("k") <= most).drop("k")
    mine, its = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    both = pair.join(mine, "u").join(its, "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return both.select("u", "v", near(common, F.size("u_set"), F.size("v_set")).alias("near"))


def near_classes(described_: DataFrame, read: DataFrame, first_docs: DataFrame) -> DataFrame:
    """(node, root) of nodes that pairs of 0.8 or more connect with others, root being the smallest.

    described_ is the stored table of described(), first_docs a document (unknown, doc_id, tie) of each node.
    """
    nodes = described_.where("size(keys) > 0").dropDuplicates(["node"]).select("node", "size", "fp", "counts")
    keyed = stored(shared_keys(described_.select("node", "keys")))
    prints = stored(print_links(described_.where("size > 0").groupBy("node").agg(F.min("fp").alias("fp"))))
    named = keyed.select("node").union(prints.select("u")).union(prints.select("v")).distinct()
    sketches = stored(nodes.join(named, "node", "left_semi").select("node", "size", "counts"))

    def sets(got):
        for batch in got:
            yield from batches(((node, h.view("i8"), counts(h, FINE)) for node, h in ((node, shingle_set(text)) for node, text in pairs(batch, "node", "text"))), _SET, 256)
        release_memory()

    picked = first_docs.join(named, "node", "left_semi")
    known = read.select(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "text")
    # Rows alike in id and text are one document, and each gives the same set.
    of_nodes = known.join(picked, ["unknown", "doc_id", "tie"]).select("node", "text")
    shingles = stored(of_nodes.mapInArrow(sets, "node long, shingles array<long>, fine binary").dropDuplicates(["node"]))

    links = first_links(keyed.join(sketches, "node")).union(prints.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).where("u <> v")
    checked = stored(_checked(links.distinct(), shingles, 1))
    refuted = checked.where("not near")
    roots = stored(components(checked.where("near"), "u", "v"))
    finer = shingles.select("node", F.size("shingles").cast("long").alias("size"), "fine")
    pair = {"x": F.greatest("u", "v"), "y": F.least("u", "v")}
    most = 1
    while True:
        rooted = keyed.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        classes = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("big"), F.count("*").alias("classes")).where("classes > 1")
        live = stored(rooted.join(classes, "key").select("key", "node", "root", (F.col("root") == F.col("big.root")).alias("big")))
        tried = refuted.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("tried"))
        asking = live.join(tried, "node", "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
        fresh = stored(further_links(asking.join(finer, "node")).withColumns(pair).join(refuted.withColumns(pair).select("x", "y"), ["x", "y"], "left_anti"))
        # Each pair of nodes once, whichever of the two looks for the other.
        links = fresh.groupBy("x", "y").agg(F.min(F.struct("u", "v")).alias("l")).select("l.*")
        most *= GROWTH
        checked, seen = stored_with(_checked(links, shingles, most), n=F.count("*"), near=F.count_if("near"))
        if not seen["n"]:
            return roots
        refuted = stored(refuted.union(checked.where("not near")))
        # Under a key, a node outside of the largest class that has found none but refuted candidates is settled with all others
        # for good, as classes only grow together; the largest class stays for those that are not.
        open_ = fresh.select("key", F.col("u").alias("node")).distinct()
        keyed = open_.union(live.where("big").select("key", "node").join(open_.select("key").distinct(), "key", "left_semi"))
        if seen["near"]:
            found = checked.where("near")
            of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
            joined = found.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
            merged = components(joined)
            every = roots.union(merged.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
            roots = stored(every.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns unchanged: that of the smallest id (null last, then by text hash).

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are what such pairs
    connect. Null and wordless texts are copies of each other; a text of fewer words is one shingle; very long ones are
    read whole. Of rows alike in id and text one stays. An empty table stays empty. The caller's columns travel in a
    struct, so their names may be any.
    """
    read = texts(docs, id_col, text_col).withColumn("tie", text_key("text"))
    known = stored(described(read))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("tie"))).alias("first")
    roots = near_classes(known, read, known.groupBy("node").agg(first).select("node", "first.*"))
    stay = known.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first).select("first.*")
    i, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(i.isNull().alias("unknown"), F.coalesce(i, F.lit(0)).alias("doc_id"), text_key(text).alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    by = Window.partitionBy("unknown", "doc_id", "tie").orderBy(F.lit(0))
    one = rows.join(stay, ["unknown", "doc_id", "tie"], "left_semi").withColumn("k", F.row_number().over(by)).where("k = 1")
    return one.select("row.*")

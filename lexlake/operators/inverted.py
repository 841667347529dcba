"""A stored inverted index: postings in blocks of a term and a set of documents, with what bounds a block's scores.

A block holds the postings of one term in one part, which is at most PART documents that were read together. Parts never change: new
and changed documents come as further parts, and what they replace is listed as dead, until the index is built again. A search puts the
blocks of the asked terms together by part, once, and meets each part with each block of queries, so what a task holds is one of either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder, stored
from .retrieval import B, K1, terms, top_per

#: Documents of a part, queries scored together, and folders of an index on disk.
PART, QUERIES, BUCKETS = 2048, 512, 64
BLOCKS = "part long, term string, n long, max_tf int, min_len int, ids array<long>, tfs array<int>, lens array<int>"
_SCHEMA = pa.schema([("part", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("max_tf", pa.int32()), ("min_len", pa.int32()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32()))])
#: The block of a part that lists all its documents, those without words too. No term is empty.
ALL = ""


def blocks(docs: DataFrame, id_col: str, text_col: str, analyse: Callable[[str], str | None] | None = None, first_part: int = 0, part_docs: int = PART) -> DataFrame:
    """The blocks of documents (ids in order within each): a part is up to part_docs rows that a task reads one after the other.

    Words are lower-cased runs of letters and digits; `analyse` makes a term of each distinct word of a part, or nothing of a stop word, which
    doesn't count as length. Null texts have no words; rows without id are left out. Of one id there should be one row.
    """

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get(), 0
        for batch in got:
            for k in range(0, batch.num_rows, part_docs):
                ids, words = (batch.column(c).slice(k, part_docs) for c in (0, 1))
                yield _part(first_part + ((task.partitionId() if task else 0) << 32) + count, ids, words, analyse)
                count += 1

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        # A table of a few files: dealt to all cores before its texts are taken apart.
        rows = rows.repartition(cores, "id")
    return rows.select("id", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("words")).mapInArrow(run, BLOCKS)


def _part(part: int, ids: pa.Array, words: pa.ListArray, analyse: Callable[[str], str | None] | None) -> pa.RecordBatch:
    order = np.argsort(ids.to_numpy(), kind="stable")
    ids, words = ids.take(pa.array(order)), words.take(pa.array(order))
    coded, doc = words.flatten().dictionary_encode(), np.repeat(np.arange(len(ids)), words.value_lengths().to_numpy())
    code, names = coded.indices.to_numpy(), coded.dictionary
    if analyse is not None:
        made = pa.array([analyse(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        code, names = made.indices.fill_null(-1).to_numpy()[code], made.dictionary
        code, doc = code[code >= 0], doc[code >= 0]
    lens = np.bincount(doc, minlength=len(ids))
    both, tfs = np.unique(code.astype(np.int64) * max(1, len(ids)) + doc, return_counts=True)
    term, d = np.divmod(both, max(1, len(ids)))
    n = np.bincount(term, minlength=len(names))
    # The block of all documents comes first.
    n, d, tfs = np.concatenate([[len(ids)], n]), np.concatenate([np.arange(len(ids)), d]), np.concatenate([np.ones(len(ids), np.int64), tfs])
    edge = np.concatenate([[0], np.cumsum(n)])
    most, least = (f.reduceat(x, edge[:-1]) if len(x) else np.zeros(1, np.int64) for f, x in ((np.maximum, tfs), (np.minimum, lens[d])))
    lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), x) for x in (ids.cast(pa.int64()).take(pa.array(d)), pa.array(tfs, pa.int32()), pa.array(lens[d], pa.int32()))]
    return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in ((np.full(len(n), part), pa.int64()), ([ALL, *names.to_pylist()], pa.string()), (n, pa.int64()), (most, pa.int32()), (least, pa.int32()))), *lists], schema=_SCHEMA)


def write_index(index: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Blocks in folders by a hash of their term, sorted by term within: a reader of some terms opens their folders, and in these skips
    row groups by the smallest and largest term. A frequent term has a row for each part, so no row grows with the corpus. How many folders
    there are is kept in the rows, as some may be empty; a folder has a file for each share of the parts, so files and sorts stay small."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    shares = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = index.withColumns({"buckets": F.lit(buckets), "bucket": bucket}).repartitionById(buckets * shares, F.col("bucket") * shares + F.pmod(F.xxhash64("part"), F.lit(shares)).cast("int"))
    dealt.sortWithinPartitions("bucket", "term", "part").write.mode("append").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS + ", buckets int, bucket int").parquet(folder)


def dead_after(index: DataFrame, changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(part, dead): ids of each part that `changed` (id) replaces or deletes, with those that were dead `before`. At most a part's documents in a row.

    Taken from the index before the changed documents' own blocks are added.
    """
    all_ = index.where(F.col("term") == ALL).select("part", F.explode("ids").alias("id"))
    now = all_.join(changed.select("id").distinct(), "id", "left_semi")
    if before is not None:
        now = now.unionByName(before.select("part", F.explode("dead").alias("id")))
    return now.groupBy("part").agg(F.collect_set("id").alias("dead"))


def updated(index: DataFrame, dead: DataFrame | None, changes: DataFrame, id_col: str, text_col: str, analyse: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks to be added, dead) after changed documents; a row of a null text only takes the document away."""
    last = index.agg(F.max("part")).first()[0]
    gone = stored(dead_after(index, changes.select(F.col(id_col).alias("id")), dead))
    return blocks(changes.where(F.col(text_col).isNotNull()), id_col, text_col, analyse, 0 if last is None else ((last >> 32) + 1) << 32), gone


def living(index: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Blocks without dead documents; those of parts without any are as they were, and bounds stay bounds."""
    if dead is None:
        return index
    all_ = index.join(dead, "part", "left")
    left = F.filter(F.arrays_zip("ids", "tfs", "lens"), lambda x: ~F.array_contains("dead", x["ids"]))
    new = all_.withColumn("left", F.when(F.col("dead").isNotNull(), left))
    parts = {c: F.coalesce(F.col(f"left.{c}"), F.col(c)) for c in ("ids", "tfs", "lens")}
    return new.withColumns(parts).withColumn("n", F.size("ids").cast("long")).where(f"n > 0 or term = '{ALL}'").drop("dead", "left")


def statistics(index: DataFrame) -> DataFrame:
    """One row (n, avg_len) of all documents."""
    parts = index.where(F.col("term") == ALL).select("n", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    return parts.agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg_len"))


def asked_terms(docs: DataFrame, id_col: str, text_col: str, analyse: Callable[[str], str | None] | None = None) -> DataFrame:
    """(query_id, term): the distinct terms of each text, by the same way as the index's."""
    return blocks(docs, id_col, text_col, analyse).where(F.col("term") != ALL).select(F.explode("ids").alias("query_id"), "term")


#: A row is one part with the asked terms: d are places in `docs`, n of them for each term.
_PACKED = "part long, docs array<long>, lens array<int>, terms array<string>, n array<int>, d array<int>, tfs array<int>"
_PACKED_SCHEMA = pa.schema([("part", pa.int64()), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("n", pa.list_(pa.int32())), ("d", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
#: A row is one block of queries: query q asks for term t with each pair of places (q, t), in order of q.
_QUERIES = "queries int, avg_len double, query_ids array<long>, terms array<string>, idf array<double>, q array<int>, t array<int>"
_HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
#: Rows of a file of parts or of blocks of queries, which Spark reads at a time; blocks of queries that a task meets its parts with.
_FILE_ROWS, _MEET = 8, 16
#: Bytes of an Arrow batch after which no further row is added.
_BATCH = 4 << 20
#: Bits of the filter of asked terms, so 1 MB; more terms than that only leave more blocks in.
_BITS = 1 << 23
#: A term is a row of a matrix if its pairs of query and document are at least one of so many cells; pairs of rarer ones are added one by one.
_DENSE, _PAIRS = 64, 1 << 18


def _in_files(df: DataFrame) -> str:
    """The folder of a stored table of large rows."""
    path = shared_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", _FILE_ROWS).parquet(path)
    return path


def _asked_blocks(index: DataFrame, named: DataFrame) -> DataFrame:
    """Blocks of the named terms and a few of others, and those of all documents: a filter of a fixed size, so that no block is shuffled for it."""
    if "buckets" in index.columns:
        n = index.where(F.col("term") == ALL).agg(F.max("buckets")).first()[0] or 1
        # At most as many as the index has folders.
        folders = [r[0] for r in named.select(F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).distinct().union(index.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(ALL)), F.lit(n)).cast("int"))).distinct().collect()]
        index = index.where(F.col("buckets").isNull() | (F.col("buckets") != n) | F.col("bucket").isin(folders))
    bit = F.xxhash64("term").bitwiseAND(F.lit(_BITS - 1))
    words = named.select(bit.alias("bit")).selectExpr("bit div 64 as word", "shiftleft(1L, cast(bit % 64 as int)) as bits")
    words = words.unionByName(index.sparkSession.range(_BITS // 64).selectExpr("id as word", "0L as bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    has = F.get(held.scalar(), F.shiftrightunsigned(bit, 6).cast("int")).bitwiseAND(F.expr("shiftleft(1L, cast(xxhash64(term) & 63 as int))")) != 0
    return index.where(has | (F.col("term") == ALL)).drop("bucket", "buckets")


def _parts(found: DataFrame, dead: DataFrame | None) -> str:
    """The table of one row for each part with living documents, without the dead ones."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(got, 1):
            table = pa.Table.from_batches(rows)
            kind, flat = table.column("kind").to_numpy(), lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
            whole, words = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 2))
            docs, lens = flat(whole, "ids"), flat(whole, "lens")
            alive = ~np.isin(docs, flat(table.filter(pa.array(kind == 1)), "ids"))
            if not alive.any():
                continue
            n = words.column("ids").combine_chunks().value_lengths().to_numpy()
            d, term = np.searchsorted(docs, flat(words, "ids")), np.repeat(np.arange(len(n)), n)
            left = alive[d]
            n, tfs, d = np.bincount(term[left], minlength=len(n)), flat(words, "tfs")[left], (np.cumsum(alive) - 1)[d[left]]
            names = words.column("term").combine_chunks().filter(pa.array(n > 0))
            out = [docs[alive], lens[alive], names, n[n > 0], d, tfs]
            yield pa.RecordBatch.from_arrays([pa.array([table.column("part")[0].as_py()], pa.int64()), *(_one(x, f.type) for x, f in zip(out, list(_PACKED_SCHEMA)[1:], strict=True))], schema=_PACKED_SCHEMA)

    spark = found.sparkSession
    kind = F.when(F.col("term") == ALL, 0).otherwise(2)
    # Lengths are those of the block of all documents.
    rows = found.select("part", kind.alias("kind"), "term", "ids", F.when(F.col("term") != ALL, F.col("tfs")).alias("tfs"), F.when(F.col("term") == ALL, F.col("lens")).alias("lens"))
    if dead is not None:
        rows = rows.unionByName(dead.select("part", F.lit(1).alias("kind"), F.lit(ALL).alias("term"), F.col("dead").alias("ids")), allowMissingColumns=True)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _in_files(rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, _PACKED))


def _one(values, kind: pa.DataType) -> pa.Array:
    """One list of values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type))


def _query_blocks(asked: DataFrame, idf: DataFrame, n_queries: int) -> str:
    """The table of blocks of some QUERIES. asked: (query_id, term); idf: (term, idf, avg_len)."""
    schema = pa.schema([("queries", pa.int32()), ("avg_len", pa.float64()), *((c, pa.list_(t)) for c, t in (("query_ids", pa.int64()), ("terms", pa.string()), ("idf", pa.float64()), ("q", pa.int32()), ("t", pa.int32())))])

    def pack(rows: pa.Table) -> pa.Table:
        ids, q = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
        coded = rows.column("term").combine_chunks().dictionary_encode()
        t, idf = coded.indices.to_numpy(), np.zeros(len(coded.dictionary))
        idf[t] = rows.column("idf").to_numpy()
        order = np.lexsort((t, q))
        out = [ids, coded.dictionary, idf, q[order], t[order]]
        one = [pa.array([rows.column("queries")[0].as_py()], pa.int32()), pa.array([rows.column("avg_len")[0].as_py()], pa.float64())]
        return pa.Table.from_arrays(one + [_one(x, f.type) for x, f in zip(out, list(schema)[2:], strict=True)], schema=schema)

    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(n_queries / QUERIES)))).cast("int")
    rows = asked.join(idf, "term").select(group.alias("queries"), "query_id", "term", "idf", "avg_len")
    return _in_files(rows.groupBy("queries").applyInArrow(pack, _QUERIES))


def search(index: DataFrame, asked: DataFrame, k: int, size: DataFrame | None = None, k1: float = K1, b: float = B, prune: bool = True, dead: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best k documents of each query (query_id, term) by Okapi BM25, ties by id; exact.

    A term's frequency is that of the index without its `dead` (part, dead), `size` (n, avg_len) its statistics unless given. Blocks are put
    together by part once, and the parts and the blocks of queries are two stored tables, of which each task reads a share of the one
    against the other: what is written grows with the index and with the queries, not with their product. A query whose k best so far
    are all above what the largest weights of a part's terms allow for skips the part. Only its best k of a task leave it.
    """
    asked = stored(asked.distinct())
    n_queries = asked.agg(F.approx_count_distinct("query_id")).first()[0]
    spark = index.sparkSession
    packed = _parts(_asked_blocks(index, asked.select("term").distinct()), dead)
    parts = spark.read.schema(_PACKED).parquet(packed)
    if size is None:
        words = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        size = parts.select(F.size("docs").alias("n"), words.alias("words")).agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg_len"))
    df = parts.select(F.explode(F.arrays_zip("terms", "n")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n").alias("df"))
    # One row, so of a fixed size.
    idf = df.crossJoin(F.broadcast(size)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avg_len")
    queries = _query_blocks(asked, idf, n_queries)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in got:
            part, block = None, None
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                number, average = row["queries"].as_py(), row["avg_len"].as_py() or 1.0
                if part is None or part.number != row["part"].as_py():
                    part = _Part(row, lambda tf, length, a=average: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / a)))
                if block is None or block.number != number:
                    block = _Block(row)
                if number not in best:
                    best[number] = _Best(np.array(block.ids), k)
                part.meet(block, best[number], prune)
            # A batch may be large, and is let go before the next one comes.
            del batch, row, part, block
        for held in best.values():
            yield held.rows()

    # Rows are some MB each, so they go to Python a few at a time, by a setting that the caller's session doesn't get.
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH))
    # Of each query, each share of the parts gives k rows: shares are as many as the machines can use, whatever the table's size.
    mine = own.read.schema(_PACKED).parquet(packed).coalesce(4 * spark.sparkContext.defaultParallelism)
    dealt = own.read.schema(_QUERIES).parquet(queries).coalesce(max(1, math.ceil(n_queries / QUERIES / _MEET)))
    hits, path = mine.crossJoin(dealt.withColumnRenamed("terms", "asked")).mapInArrow(run, "query_id long, id long, score double"), shared_folder(spark)
    hits.write.parquet(path)
    return top_per(spark.read.schema(hits.schema).parquet(path), ["query_id"], [F.desc("score"), F.asc("id")], k)


class _Block:
    """A block of queries."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.number, self.terms = row["queries"].as_py(), row["asked"].values
        self.ids, self.idf, self.q, self.t = (row[c].values.to_numpy() for c in ("query_ids", "idf", "q", "t"))


class _Best:
    """The best k of each query of a block so far, best first; places that aren't taken yet score -1."""

    def __init__(self, ids: np.ndarray, k: int):
        self.queries, self.k = ids, k
        self.scores, self.ids = np.full((len(ids), k), -1.0), np.zeros((len(ids), k), np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.unique(q)
        q = np.concatenate([q, np.repeat(at, self.k)])
        ids, scores = np.concatenate([ids, self.ids[at].ravel()]), np.concatenate([scores, self.scores[at].ravel()])
        order = np.lexsort((ids, -scores, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, place = order[place < self.k], place[place < self.k]
        self.scores[q[order], place], self.ids[q[order], place] = scores[order], ids[order]

    def rows(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.scores >= 0)
        return pa.RecordBatch.from_arrays([pa.array(self.queries[q]), pa.array(self.ids[q, place]), pa.array(self.scores[q, place])], schema=_HITS)


class _Part:
    """A part with the weights of its postings, but for the idf."""

    def __init__(self, row: dict[str, pa.Scalar], weight: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.number, self.terms = row["part"].as_py(), row["terms"].values
        self.docs, self.n, self.d = (row[c].values.to_numpy() for c in ("docs", "n", "d"))
        self.value = weight(row["tfs"].values.to_numpy().astype(np.float64), row["lens"].values.to_numpy()[self.d])
        self.start = np.cumsum(self.n) - self.n
        self.most = np.maximum.reduceat(self.value, self.start) if len(self.n) else self.value

    def meet(self, block: _Block, best: _Best, prune: bool) -> None:
        at = pc.index_in(block.terms, value_set=self.terms).fill_null(-1).to_numpy() if len(self.n) else np.full(len(block.terms), -1)
        has = at[block.t] >= 0
        q, t = block.q[has], block.t[has]
        least = best.scores[:, -1]
        bound = np.bincount(q, block.idf[t] * self.most[at[t]], len(block.ids))
        live = np.flatnonzero((bound > 0) & (bound >= least - 1e-5)) if prune else np.flatnonzero(bound > 0)
        if not len(live):
            return
        place = np.full(len(block.ids), -1)
        place[live] = np.arange(len(live))
        some = place[q] >= 0
        score = self._scores(place[q[some]], t[some], at, block.idf, len(live))
        # A rounded score may be as good as the least one if it is this near.
        good = (score > 0) & (score >= least[live, None] - 1e-6)
        many = np.flatnonzero(good.sum(1) > 4 * best.k)
        if len(many):
            bar = np.partition(score[many], -best.k, axis=1)[:, -best.k]
            good[many] &= score[many] >= bar[:, None] - 1e-6
        r, c = np.nonzero(good)
        best.add(live[r], self.docs[c], np.round(score[r, c], 6))

    def _scores(self, q: np.ndarray, t: np.ndarray, at: np.ndarray, idf: np.ndarray, n_queries: int) -> np.ndarray:
        """Of each query (place of q, in order) and document."""
        n_docs = len(self.docs)
        score = np.zeros((n_queries, n_docs))
        pairs = np.bincount(t, minlength=len(at)) * np.where(at >= 0, self.n[at], 0)
        dense = pairs * _DENSE > score.size
        wide = np.flatnonzero(dense)
        row = np.full(len(at), -1)
        for k in range(0, len(wide), 512):
            now = wide[k : k + 512]
            row[:] = -1
            row[now] = np.arange(len(now))
            asks, holds = np.zeros((n_queries, len(now))), np.zeros((len(now), n_docs))
            mine = row[t] >= 0
            asks[q[mine], row[t[mine]]] = idf[t[mine]]
            i, of = self._postings(at[now])
            holds[of, self.d[i]] = self.value[i]
            score += asks @ holds
        rare = ~dense[t]
        q, t = q[rare], t[rare]
        upto = np.cumsum(self.n[at[t]])
        edges = [0]
        while edges[-1] < len(t):
            a = edges[-1]
            edges.append(max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, "right"))))
        for a, z in zip(edges, edges[1:], strict=False):
            i, of = self._postings(at[t[a:z]])
            first, last = q[a], q[z - 1] + 1
            cell = ((q[a:z] - first) * n_docs)[of] + self.d[i]
            score[first:last] += np.bincount(cell, self.value[i] * idf[t[a:z]][of], (last - first) * n_docs).reshape(-1, n_docs)
        return score

    def _postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the postings of terms one after the other, which of the terms)."""
        n = self.n[terms]
        of = np.repeat(np.arange(len(terms)), n)
        return np.arange(len(of)) + (self.start[terms] - (np.cumsum(n) - n))[of], of


def _groups(got: Iterator[pa.RecordBatch], n: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of the first n columns, which follow each other and may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in got:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(n)], 1)
        edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, z in zip(edge, edge[1:], strict=False):
            now = tuple(key[a].tolist())
            if held and now != last:
                yield held
                held = []
            held.append(batch.slice(a, z - a))
            last = now
    if held:
        yield held

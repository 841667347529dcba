"""Token ids in binary files: one zstandard frame for each document under a shared dictionary, found through an offset index."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batches, pairs, shared_folder, stored, texts
from .words import encoder

MAGIC = b"LXTOKEN1"
HEAD = struct.Struct("<8s32sBQQ")  # magic, sha256 of the dictionary, bytes of an id, documents, where the index starts
END = (0).to_bytes(4, "little")
DICTIONARY_BYTES = 32 << 10
SAMPLE_DOCS, SAMPLE_CHARS = 512, 8192
DOCS_A_SHARD, MOST_SHARDS, FILE_BYTES = 4096, 10_000, 64 << 20


def serialize(ids: bytes, width: int) -> bytes:
    """32-bit ids in as few bytes as the vocabulary needs."""
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; their plain bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def shared_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class TokenFile:
    """A file's documents, each read and decompressed alone, through the index: only head and index are held.

    `source` is an open file with seek and read, as pyarrow and Python give them, or the bytes of a file.
    """

    def __init__(self, source, dictionary: bytes):
        self.source = io.BytesIO(source) if isinstance(source, bytes) else source
        magic, sha, self.width, self.n, at = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("another dictionary")
        self.lens = zstandard.ZstdDecompressor(dict_data=shared_dictionary(dictionary))
        index = self._read(at, 25 * self.n + 16)
        self.ids = np.frombuffer(index, "<i8", self.n)
        self.known = np.frombuffer(index, "u1", self.n, 8 * self.n)
        self.offsets = np.frombuffer(index, "<u8", self.n + 1, 9 * self.n)
        self.starts = np.frombuffer(index, "<u8", self.n + 1, 17 * self.n + 8)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        frame = self._read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
        return np.frombuffer(self.lens.decompress(frame), f"<u{self.width}").astype("<u4")


def write_file(docs: list[tuple[int | None, int, bytes]], width: int, dictionary_sha: bytes) -> bytes:
    """Of (id, number of token ids, frame) in their order."""
    n = len(docs)
    ends = np.cumsum([HEAD.size, *(len(f) for _, _, f in docs)], dtype="<u8")
    starts = np.cumsum([0, *(c for _, c, _ in docs)], dtype="<u8")
    index = np.array([i or 0 for i, _, _ in docs], "<i8").tobytes() + np.array([i is not None for i, _, _ in docs], "u1").tobytes() + ends.tobytes() + starts.tobytes()
    return b"".join([HEAD.pack(MAGIC, dictionary_sha, width, n, int(ends[-1])), *(f for _, _, f in docs), index])


def _put(path: str, data: bytes) -> None:
    where, name = pafs.FileSystem.from_uri(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as out:
        out.write(data)


def _open(path: str):
    """For reading at any place."""
    where, name = pafs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def read_document(path: str, folder: str, k: int) -> np.ndarray:
    """Ids of the k-th document of one file, without reading the others."""
    with _open(f"{folder}/dictionary.zdict") as got:
        dictionary = got.read()
    with _open(path) as got:
        return TokenFile(got, dictionary).document(k)


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes all documents' ids, each with the end id 0, in ascending id order; returns (manifest, folder).

    The manifest has a row for each file: shard, part, path, n_docs, n_ids; in that order the files hold the ids
    ascending. Shards are id ranges at quantiles, so that no key or source makes one large; a shard of more than
    FILE_BYTES goes on in further files. Null ids come first; rows that share an id go by their text's hash; null
    text is empty. A file's name is new for each attempt of a task and only the manifest, stored after all were
    written, says which count: a lost executor's files are ignored. The folder is below spark.checkpoint.dir.

    Very long texts are encoded whole; repeated rows are written each; an empty table gives no files and an empty
    manifest; other columns play no part.

    The dictionary is trained on the id arrays of at most SAMPLE_DOCS documents, those with the smallest hash of their
    id, of each no more than its first SAMPLE_CHARS characters: a bounded sample that only affects the files' size.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    folder = folder or shared_folder(spark)
    enc = encoder(path)
    width = 2 if enc.library.get_vocab_size() <= 1 << 16 else 4
    # Each task names that many ids at most; only the chosen documents' texts come to the driver.
    some = rows.where("doc_id is not null and text <> ''")
    chosen = [r.doc_id for r in some.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()]
    piece = F.substring("text", 1, SAMPLE_CHARS).alias("text")
    sample = some.where(F.col("doc_id").isin(chosen)).orderBy("doc_id", F.xxhash64("text")).select(piece).limit(SAMPLE_DOCS).collect() if chosen else []
    dictionary = train_dictionary([serialize(enc.encode(r.text) + END, width) for r in sample])
    sha = hashlib.sha256(dictionary).digest()
    _put(f"{folder}/dictionary.zdict", dictionary)

    n = rows.count()
    shards = max(1, min(MOST_SHARDS, math.ceil(n / DOCS_A_SHARD)))
    cuts = np.array(rows.select("doc_id").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 else [], np.float64)

    def encode(got):
        enc, press = encoder(path), zstandard.ZstdCompressor(level=1, dict_data=shared_dictionary(dictionary))
        for batch in got:
            def made(batch=batch):
                for i, text, tie in pairs(batch, "doc_id", "text", "tie"):
                    ids = enc.encode(text) + END
                    yield 0 if i is None else int(np.searchsorted(cuts, float(i), "right")), i, tie, len(ids) // 4, press.compress(serialize(ids, width))

            yield from batches(made(), _FRAMES, 1024)

    def write(got):
        def all_rows() -> Iterator[tuple]:
            for batch in got:
                yield from pairs(batch, "shard", "doc_id", "n", "frame")

        def files() -> Iterator[tuple]:
            shard, part, held, size = None, 0, [], 0
            for s, i, c, frame in all_rows():
                if held and (s != shard or size >= FILE_BYTES):
                    yield put(shard, part, held)
                    part, held, size = (part + 1 if s == shard else 0), [], 0
                shard = s
                held.append((i, c, frame))
                size += len(frame)
            if held:
                yield put(shard, part, held)

        def put(shard: int, part: int, held: list) -> tuple:
            name = f"{folder}/shard-{shard:06d}-{part:05d}-{uuid.uuid4().hex}.tok"
            _put(name, write_file(held, width, sha))
            return shard, part, name, len(held), sum(c for _, c, _ in held)

        yield from batches(files(), _FILES, 64)

    frames = rows.withColumn("tie", F.xxhash64("text")).mapInArrow(encode, "shard int, doc_id long, tie long, n long, frame binary")
    dealt = frames.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    return stored(dealt.mapInArrow(write, "shard int, part int, path string, n_docs long, n_ids long")), folder


_FRAMES = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])
_FILES = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_IDS = _DOCS.append(pa.field("ids", pa.binary()))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted.

    A row for each document that was written, null ids and repeated rows included, a document without text being its end id alone; an empty
    manifest gives no rows. A file is read in one go; one whose dictionary isn't the folder's raises.
    """
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))

    def read(got):
        with _open(f"{folder}/dictionary.zdict") as kept:
            dictionary = kept.read()
        for batch in got:
            for path, base in pairs(batch, "path", "base"):
                # At most FILE_BYTES and a document: read in one go, as all of it is wanted.
                with _open(path) as one:
                    file = TokenFile(one.read(), dictionary)

                def made(file=file, base=base):
                    for k in range(file.n):
                        ids = file.document(k)
                        if len(ids) != int(file.starts[k + 1] - file.starts[k]):
                            raise ValueError("a document's length differs from the index")
                        row = (int(file.ids[k]) if file.known[k] else None, base + int(file.starts[k]), len(ids), zlib.crc32(ids.tobytes()))
                        yield (*row, ids.tobytes()) if with_ids else row

                yield from batches(made(), _IDS if with_ids else _DOCS)

    n = max(1, min(MOST_SHARDS, manifest.count()))
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)

"""Packing documents into fixed windows by the sum-of-squares rule, documents cut only where a window would be padded."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import batches, pairs, texts
from .words import encoder

END = (1).to_bytes(4, "little")
MAX_OPEN = 4096

#: (document, start in the document, ids as bytes, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Online packing. filled[h]: how many open windows hold h tokens. An item of s tokens goes to the window whose
    level h makes the sum of filled[h]**2 smallest; a window that becomes full leaves the array.

    Items longer than a window are cut into whole windows first, only the rest is placed. When more than max_open
    windows are open (which bounds the memory), the fuller half of them is laid end to end and cut at whole windows; the
    others stay open for the rule. At the end all that is left goes this way, its last rest cut into windows of powers
    of two, which need no padding.
    """

    def __init__(self, size: int = 2048, max_open: int = MAX_OPEN):
        self.size, self.max_open, self.n_open = size, max_open, 0
        self.filled = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def level(self, s: int) -> int:
        """The level to put s tokens on; 0 is a new window."""
        n, size = self.filled, self.size
        change = np.zeros(size - s + 1, np.int64)
        change[1:] = 1 - 2 * n[1 : size - s + 1]
        change[: size - s] += 1 + 2 * n[s:size]
        change[1:][n[1 : size - s + 1] == 0] = np.iinfo(np.int64).max
        return size - s - int(np.argmin(change[::-1]))  # of equals the fullest

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Windows that become full."""
        doc, start, ids, total = piece
        step = 4 * self.size
        whole = len(ids) // step * step
        for k in range(0, whole, step):
            yield [(doc, start + k // 4, ids[k : k + step], total)]
        rest = (doc, start + whole // 4, ids[whole:], total)
        s = len(rest[2]) // 4
        if not s:
            return
        h = self.level(s)
        window = []
        if h:
            window = self.open[h].pop()
            self.filled[h] -= 1
            self.n_open -= 1
        window.append(rest)
        if h + s == self.size:
            yield window
            return
        self.open[h + s].append(window)
        self.filled[h + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.drain(self.max_open // 2, last=False)

    def drain(self, keep: int = 0, last: bool = True) -> Iterator[list[Piece]]:
        """Closes open windows, fullest first, so that most keep their pieces whole, until `keep` are left."""
        left: list[Piece] = []
        for h in sorted(self.open, reverse=True):
            while self.open[h] and self.n_open > keep:
                left += self.open[h].pop()
                self.filled[h] -= 1
                self.n_open -= 1
            if not self.open[h]:
                del self.open[h]
        rest = sum(len(p[2]) for p in left) // 4
        window: list[Piece] = []
        room = self._room(rest, last)
        for doc, start, ids, total in left:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, part, total))
                start, room, rest = start + len(part) // 4, room - len(part) // 4, rest - len(part) // 4
                if not room:
                    yield window
                    window, room = [], self._room(rest, last)
        if window:
            h = sum(len(p[2]) for p in window) // 4
            self.open[h].append(window)
            self.filled[h] += 1
            self.n_open += 1

    def _room(self, rest: int, last: bool) -> int:
        return self.size if rest >= self.size or not last else 1 << max(0, rest.bit_length() - 1)


PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED_IDS = PACKED.append(pa.field("ids", pa.binary()))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, max_open: int = MAX_OPEN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    Every document is its tokenizer ids and an end id, 1. Each partition of the input packs its own documents as
    they come, so nothing is shuffled and a task that runs again gives the same rows; sequence_id holds the
    partition in its upper bits. Sequences have `size` tokens but for at most log2(size) shorter ones at the end
    of a partition, each of a power of two: nothing is padded. A null or empty text is its end id alone; a very long
    one is cut into whole windows; a null id stays null; repeated rows are packed each; of levels that cost the same the
    fullest is taken; an empty table gives no rows; other columns play no part.
    """

    def run(got):
        enc, task = encoder(path), TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        packer, count = SumOfSquares(size, max_open), 0

        def rows(window: list[Piece]) -> Iterator[tuple]:
            nonlocal count
            at = 0
            for doc, start, ids, total in window:
                row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, base + count, at)
                yield (*row, ids) if with_ids else row
                at += len(ids) // 4
            count += 1

        def all_rows() -> Iterator[tuple]:
            for batch in got:
                for doc, text in pairs(batch, "doc_id", "text"):
                    ids = enc.encode(text) + END
                    for window in packer.add((doc, 0, ids, len(ids) // 4)):
                        yield from rows(window)
            for window in packer.drain():
                yield from rows(window)

        yield from batches(all_rows(), PACKED_IDS if with_ids else PACKED)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return texts(docs, id_col, text_col).mapInArrow(run, ddl + ", ids binary" * with_ids)

"""BPE encoding and decoding: speculate with greedy longest matches, verify adjacent pairs, merge exactly only what fails.

A token sequence is what byte-pair merging gives if and only if each token alone merges to itself and, at each
boundary, no pair of symbols that ever stand next to each other across it merges before either is taken into its
own token. The second test needs the two tokens only, so it is done once for each distinct pair, as numpy arrays.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytelevel import byte_alphabet
from .shared import batches, cached, pairs, texts
from .words import packed

_NEVER = np.int64(1) << 40
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SpeculativeBPE:
    """Encodes and decodes as the tokenizers library does with the BPE file at `path`.

    Files of two kinds are known: byte level with its own split, and normalized (NFC, white space, lower case)
    text split by a pattern, with a word-end suffix. Others raise ValueError.
    """

    def __init__(self, path: str, limit: int = 700_000):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model, pre = conf["model"], conf["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain BPE model")
        steps = pre.get("pretokenizers", [pre])
        kinds = [n["type"] for n in (conf["normalizer"] or {}).get("normalizers", [])]
        if [s["type"] for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not conf["normalizer"]:
            pattern, self.folded = _BYTE_LEVEL, False
        elif [s["type"] for s in steps] == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"]:
            pattern, self.folded = steps[0]["pattern"]["Regex"], True
        else:
            raise ValueError("a tokenizer of another kind")
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.spaced = conf["decoder"] is None  # without a decoder the library joins tokens by spaces
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.longest = max(map(len, self.vocab))
        self.limit = limit
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.failed = self.seen = 0
        self._tables(model["merges"])

    def _tables(self, merges: list) -> None:
        n = max(self.vocab.values()) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys, ranks, made_by, self.merge = [], [], [], {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = self.vocab[a], self.vocab[b]
            t = self.vocab[a.removesuffix(self.suffix) + b if self.suffix else a + b]
            self.merge.setdefault((x, y), (r, t))
            keys.append(x * n + y)
            ranks.append(r)
            made_by.append(t)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.n, self.keys, self.ranks = n, np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.made = np.array(made_by, np.int64)
        # A token is its own encoding if both halves are theirs and nothing merges across their boundary first.
        made = np.flatnonzero(self.rank >= 0)
        inner = self.compatible(self.left[made], self.right[made], top=False)
        self.whole = np.ones(n, bool)
        for t, ok in sorted(zip(made.tolist(), inner.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            self.whole[t] = ok and self.whole[self.left[t]] and self.whole[self.right[t]]

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = x * self.n + y
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """For each pair whether merging the two tokens' symbols keeps the boundary; top=False leaves out the whole tokens' own merge.

        Goes back in time along the right edge of a and the left edge of b, undoing the later merge first. A
        pair of symbols merges across the boundary if its rank is below that of the merge that takes the left
        symbol away, and not above that of the merge that takes the right one (the leftmost goes first).
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        gone_x, gone_y = np.full(len(a), _NEVER - 1), np.full(len(a), _NEVER - 1)
        while len(live):
            if top:
                r = self._pair_rank(x, y)
                bad = (r < gone_x) & (r <= gone_y)
                ok[live[bad]] = False
            else:
                bad, top = np.zeros(len(live), bool), True
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, gone_x, gone_y, rx, ry = (v[on] for v in (live, x, y, gone_x, gone_y, rx, ry))
            undo = rx > ry
            gone_x, gone_y = np.where(undo, rx, gone_x), np.where(undo, gone_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def propose(self, word: str) -> list[int]:
        """Greedy longest matches; only the last may carry the word-end suffix."""
        get, end, i, out = self.vocab.get, len(word), 0, []
        while i < end:
            t = get(word[i:] + self.suffix) if end - i <= self.longest else None
            j = end
            while t is None:
                j = min(j - 1, i + self.longest)
                if j <= i:
                    return []
                t = get(word[i:j])
            out.append(t)
            i = j
        return out

    def exact(self, word: str) -> list[int]:
        """Byte-pair merging: again and again the merge of the lowest rank, leftmost first."""
        ids = [t for c in word[:-1] if (t := self.vocab.get(c)) is not None] + [t for t in [self.vocab.get(word[-1] + self.suffix)] if t is not None]
        merge, none = self.merge, (1 << 40, -1)
        if len(ids) > 200:
            return self._exact_long(ids)
        found = [merge.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k < len(found):
                found[k] = merge.get((ids[k], ids[k + 1]), none)
            if k:
                found[k - 1] = merge.get((ids[k - 1], ids[k]), none)
        return ids

    def exact_many(self, words: list[str]) -> list[list[int]]:
        """The same for many words, as rows of one array of each length: all make their next merge at once."""
        get, out, by_length = self.vocab.get, [[] for _ in words], {}
        for k, w in enumerate(words):
            ids = [t for t in [*map(get, w[:-1]), get(w[-1] + self.suffix)] if t is not None]
            if len(ids) > 24:
                out[k] = self.exact(w)
            else:
                by_length.setdefault(len(ids), []).append((k, ids))
        for n, group in by_length.items():
            if n:
                for (k, _), ids in zip(group, self._merged(np.array([ids for _, ids in group], np.int64)), strict=True):
                    out[k] = ids
        return out

    def _merged(self, ids: np.ndarray) -> list[list[int]]:
        """Of rows of symbols of one length: the rows after all merges, by linked neighbours."""
        count, n = ids.shape
        after, before = np.tile(np.arange(1, n + 1), (count, 1)), np.tile(np.arange(-1, n - 1), (count, 1))
        there, rank, on = np.ones((count, n), bool), np.full((count, n), _NEVER), np.arange(count)
        rank[:, :-1] = self._pair_rank(ids[:, :-1], ids[:, 1:])
        while len(on):
            now = rank[on]
            k = now.argmin(1)
            best = now[np.arange(len(on)), k]
            some = best < _NEVER
            on, k, best = on[some], k[some], best[some]
            ids[on, k] = self.made[best]
            gone = after[on, k]
            there[on, gone], rank[on, gone] = False, _NEVER
            rank[on, k] = _NEVER
            after[on, k] = follows = after[on, gone]
            more = follows < n
            row, x, y = on[more], k[more], follows[more]
            before[row, y] = x
            p = before[on, k]
            more = p >= 0
            row, x, y = (np.append(u, v[more]) for u, v in ((row, on), (x, p), (y, k)))
            rank[row, x] = self._pair_rank(ids[row, x], ids[row, y])
        return [list(compress(x, t)) for x, t in zip(ids.tolist(), there.tolist(), strict=True)]

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for words of many symbols."""
        n, merge = len(ids), self.merge
        after, before, there = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y, t = heapq.heappop(heap)
            j = after[k] if there[k] else n
            if j >= n or ids[k] != x or ids[j] != y:
                continue
            ids[k], there[j], after[k] = t, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q < n and (m := merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t, here in zip(ids, there, strict=True) if here]

    def learn(self, words: list[str]) -> None:
        """Encodes words not yet known, all their pairs in one check."""
        mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in words]
        tried = [self.propose(w) for w in mapped]
        flat = np.array([t for x in tried for t in x], np.int64)
        fine = np.ones(len(words), bool)
        fine[[k for k, x in enumerate(tried) if not x]] = False
        owner = np.repeat(np.arange(len(words)), np.array([len(x) for x in tried], np.int64))
        fine[owner[~self.whole[flat]]] = False
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, np.int64)
        kinds, which = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        fine[owner[inside[~self.compatible(kinds // self.n, kinds % self.n)[which]]]] = False
        self.seen, self.failed = self.seen + len(words), self.failed + int((~fine).sum())
        merged = iter(self.exact_many([m for m, ok in zip(mapped, fine.tolist(), strict=True) if not ok]))
        for w, x, ok in zip(words, tried, fine.tolist(), strict=True):
            self.words[w] = tuple(x if ok else next(merged))

    def split(self, text: str) -> list[str]:
        if self.folded:  # one character at a time, as the library folds: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.find(text)

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """(piece, is it a special token)."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, False)]
        return [(p, p in self.special) for p in self.cut.split(text) if p]

    def encode(self, text: str | None) -> list[int]:
        found = [([self.special[p]] if own else self.split(p), own) for p, own in self.parts(text or "")]
        new = {w for x, own in found if not own for w in x if w not in self.words}
        if new:
            if len(self.words) > self.limit:
                self.words.clear()
                new = {w for x, own in found if not own for w in x}
            self.learn(list(new))
        return [t for x, own in found for t in (x if own else [i for w in x for i in self.words[w]])]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        tokens = [self.token[i] for i in ids if i in self.token]
        if self.spaced:
            return " ".join(tokens)
        return b"".join([bytes([self.byte_of[c] for c in t]) if all(c in self.byte_of for c in t) else t.encode() for t in tokens]).decode("utf-8", "replace")

    def encode_many(self, many: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each; with folded text through a cache of pieces between spaces."""
        if not (self.folded and self.spaced):
            for text in many:
                ids = self.encode(text)
                yield packed(ids), self.decode(ids)
            return
        split = [(t or "").split(" ") for t in many]
        needed = {p for x in split for p in x}
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        # Nothing here refers to itself, and looking for it among millions of pieces takes long.
        collecting = gc.isenabled()
        gc.disable()
        try:
            self._pieces(needed - self.chunks.keys())
        finally:
            if collecting:
                gc.enable()
        for x in split:
            got = [self.chunks[p] for p in x]
            yield b"".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]

    def _pieces(self, new: set[str]) -> None:
        line = "\n".join(new)
        if any(s in line for s in self.special):
            found = [(p, [([t], True) if own else (self.split(t), False) for t, own in self.parts(p)]) for p in new]
        else:
            found = [(p, [(self.split(p), False)]) for p in new]
        words = {w for _, parts in found for x, own in parts if not own for w in x}
        if len(self.words) > self.limit:
            self.words.clear()
        self.learn([w for w in words if w not in self.words])
        for p, parts in found:
            ids = [i for x, own in parts for w in x for i in ((self.special[w],) if own else self.words[w])]
            self.chunks[p] = (packed(ids), "".join([" " + self.token[i] for i in ids]))


def coder(path: str) -> SpeculativeBPE:
    """One for each Python worker."""
    return cached("bpe", path, lambda: SpeculativeBPE(path))


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each input row, in no order: doc_id, ids (little-endian unsigned 32-bit), decoded.

    digest=True gives n_tokens, ids_sha256, decoded_sha256 in place of ids and text. A null text is empty: no
    ids. A null id stays null. Repeated rows are encoded each, equal texts alike. Very long texts and words are encoded whole. An
    empty table gives an empty one. Other columns play no part, whatever their names.
    """

    def run(got):
        bpe = coder(path)
        for batch in got:
            rows = list(pairs(batch, "doc_id", "text"))
            for k in range(0, len(rows), 512):
                part = rows[k : k + 512]
                made = zip(part, bpe.encode_many([t for _, t in part]), strict=True)
                if digest:
                    yield from batches(((i, len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (i, _), (b, d) in made), DIGEST)
                else:
                    yield from batches(((i, b, d) for (i, _), (b, d) in made), CODED)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary, decoded string")

"""Ids of whole texts as the tokenizers library gives them, through caches of the pieces between spaces."""

from __future__ import annotations

import json
import re
import sys
from array import array

from .bytelevel import byte_alphabet
from .shared import cached, one_thread

#: A space before which a byte-level tokenizer may not be cut: one that white space or the end follows.
_GAP = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_BYTES = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
CACHED = 700_000


class ChunkEncoder:
    """encode(text) equals the library's encode(text, add_special_tokens=False).ids as little-endian 32-bit integers.

    A text is cut only where neither pre-tokenizer of the two known kinds can join what stands on either side:
    before a space that a non-space follows (byte level; the space goes to the right piece), or at any space
    (a split that drops white space). Each distinct piece is encoded by the library when it first comes: plain
    Latin words by its model alone, all else by its whole encode(). Other kinds of tokenizer get whole texts.
    The caches hold at most CACHED pieces.
    """

    def __init__(self, path: str, limit: int = CACHED):
        one_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        kinds = [n["type"] for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        self.spaced = conf.get("normalizer") is None and [s.get("type") for s in steps] == ["ByteLevel"] and steps[0].get("use_regex") and not steps[0].get("add_prefix_space")
        self.dropped = kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.first = _Pieces(self, "", limit // 2)
        self.later = _Pieces(self, " " if self.spaced else "", limit)

    def whole(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.spaced:
            pieces = _CUT.split(text) if _GAP.search(text) else text.split(" ")
            return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))
        if self.dropped:
            return b"".join(map(self.later.__getitem__, text.replace("\n", " ").split(" ")))
        return self.whole(text)


class _Pieces(dict):
    """Ids of pieces, `lead` before each; found when first asked for."""

    def __init__(self, owner: ChunkEncoder, lead: str, limit: int):
        super().__init__()
        self.owner, self.limit = owner, limit
        self.lead, self.mapped_lead = lead, lead.translate(_BYTES)
        self.tokenize = owner.library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        got = self[piece] = self._ids(piece)
        return got

    def _ids(self, piece: str) -> bytes:
        if _LATIN.fullmatch(piece):
            return self._word(piece)
        if piece[-1:] in (".", ",") and _LATIN.fullmatch(piece, 0, len(piece) - 1):
            return self._word(piece[:-1]) + self.owner.first[piece[-1]]
        parts = piece.split("\n")
        if len(parts) > 1 and self.owner.spaced and all(p and p.split() == [p] for p in parts):
            return self[parts[0]] + b"".join([self.owner.first["\n"] + self.owner.first[p] for p in parts[1:]])
        return self.owner.whole(self.lead + piece)

    def _word(self, word: str) -> bytes:
        low = word.lower() if self.owner.dropped else word
        if not low.isalpha():
            return self.owner.whole(self.lead + word)
        return packed([t.id for t in self.tokenize(self.mapped_lead + low.encode().decode("latin-1").translate(_BYTES))])


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker: its caches serve all tasks that the worker gets."""
    return cached("words", path, lambda: ChunkEncoder(path))

"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained from LABELLED below, a small table of lines with marked spans, and decoded by Viterbi on
numpy batches. Most words are certain: where the score of "other" beats every label by more than any change of
the two transitions around the word can give back, no best path has another label there. Such words cut a text
into short independent runs, all runs of a batch are decoded together, and the result is that of decoding each
text as one chain.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batches, cached, pairs, texts

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)

#: The labelled table, one line of words each; {kind:...} marks a span.
LABELLED = """
write to {email:the.44@mail4.example.com} about the thing
mail {email:anna.smith@corp.example.org} or call {phone:+1 (916) 555-6549} today
her address is {email:j_doe+news@example.co.uk}.
contact {email:oning.10@mail8.example.com} and the rest of it
send it to <{email:info@site.example.net}> please
Das ist {email:zu.71@mail2.example.com} und der rest.
ecrivez a {email:le.42@mail6.example.com}, merci
la direccion {email:osue.33@mail0.example.com} de la casa
reply: {email:bob@localhost} thanks
{email:no.reply@mail1.example.com}
ask {email:max@intern} first, then {email:eva@team}
from the host {ip:129.190.225.188} que more
ping {ip:10.0.0.1} and {ip:192.168.1.254}, then wait
at {ip:22.102.42.45} in the log
blocked {ip:205.81.33.169}.
server {ip:8.8.8.8} answered in time
version 1.2 of the tool and section 3.4.5 of it
release 2.10.3, chapter 4.1 and so on
the card {card:4497672581733027} was used
paid with {card:4111 1111 1111 1111} in the shop
paid with {card:5500-0000-0000-0004}, he said
number {card:1704182936937500} de evir
card no. {card:1246187892706766}.
charge {card:378282246310005 } later
la tarjeta {card:6375 9861 0248 2655} the rest
call {phone:+1 (511) 555-6887} or wait
phone {phone:+44 20 7946 0958} for help
ring {phone:+1 (098) 555-0174} as and in
tel {phone:+49 30 901820} bitte
fax {phone:(652) 555-4544} and to the
dial {phone:555-0196} now
dial {phone:916-555-6549} and ask
at {phone:(916) 555-7479}, daily
tel. {phone:916.555.6973} from the office
{phone:+33 1 42 68 53 00} est le numero
thing token = "{secret:681c09b8e90e7e8c9575180f595f646cf29}" and more
the token = "{secret:58ed55e8cc700f5a0109593b09891d0a1a8}"
password = "{secret:a8f5f167f44f4964e6c998dee827110c}" was found
KEY = "{secret:9233A8ECF7C5B09FE5949719B6B82BC439E93}" THE
api_key: {secret:sk4f9a0c7be21d77aa0c3e5b8f6d2e4a1b}
secret={secret:ede43f42c939b6405768150e0411590525c}
token = "{secret:dafbac99949115180e7593de87b4492bcef98}" de la
in 2024 there were 1200 of them and 35 left
on 2021-05-17 at 10:30 he paid 49.99 for 3 items
from 1999 to 2005, about 12,500 people
the 3rd of May, room 204, page 17
chapter 12. It was 7 o'clock
Of%%% athe*** erntwh.%%% Thntatwh&&& ndreea$$$ an%%% as%%%
DE!! UNE!! LE!! LE!! ENOI!! LEEUXOI!! EAU.
clown### onthtion&&& trash### be%%% heshed$$$ th.
thehaeren | thinou | thtiononnd | onntes | retioninble
Of In Of In De De De De ciones ciones
The and attion to thanedble the, anea. Eriner thanea.
Licensed under the Apache License, Version 2.0.
Copyright (c) 2019 the authors. All rights reserved.
Thonble haer ertireha onti theratnt the.
Der eingea erer, und die achlich ist zu.
Que la tion est dans l'eau d'une ville.
"quoted words" and (words in brackets) - and dashes -- here
see http://www.example.com/page?id=7 for more
step 1: open; step 2: close; step 3) done
he said: "wait", and she's gone -- don't
x = 3 + 4 and y = 10 * 2
it costs $5.00 or 10% more, #1 of 3
a b c d e f g 1 2 3 4 5
ISBN 978 and volume 22, no. 7
order A-113 and part X200b shipped
""".strip().splitlines()

TOGETHER = 1 << 20

_SPACE = re.compile(r"\S+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part can only end at an @, so the search goes from one @ to the next; no start is tried twice."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = at = m.end()
        else:
            done = at = at + 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of dotted numbers, four parts at a time from the left."""
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """The four patterns, each leftmost and non-overlapping; matches that fail their test are dropped without retries."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        found += [("ip", s, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


_RUNS = [(re.compile("[A-Z]+"), "A"), (re.compile("[a-zª-ɏḀ-ỿ]+"), "a"), (re.compile("[0-9]+"), "0")]
_PLAIN = re.compile("[^\\W\\d_]+[.,]?")
_HEX = re.compile("[0-9A-Za-z]*(?:[0-9][A-Za-z]+[0-9][A-Za-z]+[0-9])[0-9A-Za-z]*")


def shape_features(word: str) -> tuple[str, ...]:
    """What the field sees of a word; words of letters are all alike, so that invented words do not matter."""
    if _PLAIN.fullmatch(word):
        return ("plain",)
    core = word.strip("\"'<>[]{},;:!?%*$&#|")
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    shape = core[:64].replace("a", "b").replace("A", "B").replace("0", "1")
    for run, sign in _RUNS:
        shape = run.sub(sign, shape)
    out = ["odd", f"shape={shape[:24]}", f"digits={min(digits, 4) if digits < 5 else '5-9' if digits < 10 else '10-15' if digits < 16 else '16-19' if digits < 20 else '20+'}"]
    if "@" in core[1:-1]:
        out.append("at")
    if digits and not letters:
        out.append("numeric")
        if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}\.?", core):
            out.append("quad")
        if re.fullmatch(r"\d{3,4}[-.]\d{4}\.?|\d{3}[-.]\d{3}[-.]\d{4}\.?", core):
            out.append("dial")
        if re.fullmatch(r"\(\d{2,4}\)", core):
            out.append("area")
        if core[0] == "+":
            out.append("plus")
        if re.fullmatch(r"\d{4}(?:-\d{4}){3}\.?", core):
            out.append("grouped")
        if re.fullmatch(r"\d{4}[.,]?", core):
            out.append("four")
        if re.fullmatch(r"\d{16,19}\.?", core):
            out.append("sixteen")
    elif digits >= 3 and letters >= 3 and len(core) >= 20 and _HEX.search(core):
        out.append("hex")
    if not digits and not letters:
        out.append("signs")
    return tuple(out)


def parse_labelled(lines: list[str]) -> list[tuple[list[str], list[int]]]:
    """Words and label numbers of the table's lines: a word has the kind of a span that it overlaps."""
    out = []
    for line in lines:
        plain, spans = "", []
        for part in re.split(r"(\{[a-z]+:[^}]*\})", line):
            if m := re.fullmatch(r"\{([a-z]+):([^}]*)\}", part):
                spans.append((m[1], len(plain), len(plain) + len(m[2])))
                part = m[2]
            plain += part
        words = list(_SPACE.finditer(plain))
        out.append(([w[0] for w in words], [next((LABELS.index(k) for k, s, e in spans if w.start() < e and s < w.end()), 0) for w in words]))
    return out


class Field:
    """Weights of a trained linear-chain field: own, previous and next word's features by label, and transitions."""

    def __init__(self, names: dict[str, int], own: np.ndarray, prev: np.ndarray, after: np.ndarray, moves: np.ndarray):
        self.names, self.own, self.prev, self.after, self.moves = names, own, prev, after, moves

    @classmethod
    def train(cls, lines: list[str], steps: int = 300, rate: float = 0.1, decay: float = 0.02) -> Field:
        """Maximum likelihood with a Gaussian prior, by gradient steps with momentum scaled to each weight (Adam)."""
        rows = [(w, y) for w, y in parse_labelled(lines) if w]
        feats = [[shape_features(w) for w in words] for words, _ in rows]
        names = {f: k for k, f in enumerate(sorted({f for x in feats for fs in x for f in fs}))}
        n, longest, f, k = len(rows), max(len(w) for w, _ in rows), len(names), len(LABELS)
        here = np.zeros((n, longest, f))
        gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (x, (_, y)) in enumerate(zip(feats, rows, strict=True)):
            for t, fs in enumerate(x):
                here[i, t, [names[q] for q in fs]] = 1
            gold[i, : len(y)], mask[i, : len(y)] = y, True
        before = np.pad(here, ((0, 0), (1, 0), (0, 0)))[:, :-1]
        behind = np.pad(here, ((0, 0), (0, 1), (0, 0)))[:, 1:]
        x = np.concatenate([here, before, behind], axis=2)
        w, moves = np.zeros((3 * f, k)), np.zeros((k, k))
        one = np.eye(k)[gold] * mask[..., None]
        seen = np.einsum("itf,itk->fk", x, one)
        seen_moves = np.einsum("itj,itk->jk", one[:, :-1], one[:, 1:])
        m = [np.zeros_like(w), np.zeros_like(moves)]
        v = [np.zeros_like(w), np.zeros_like(moves)]
        for step in range(1, steps + 1):
            score = x @ w
            p, pairs_ = cls._marginals(score, moves, mask)
            grads = [seen - np.einsum("itf,itk->fk", x, p) - decay * n * w / 10, seen_moves - pairs_ - decay * n * moves / 10]
            for a, (value, g) in enumerate(zip((w, moves), grads, strict=True)):
                m[a] = 0.9 * m[a] + 0.1 * g
                v[a] = 0.999 * v[a] + 0.001 * g * g
                value += rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)
        return cls(names, w[:f], w[f : 2 * f], w[2 * f :], moves)

    @staticmethod
    def _marginals(score: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward on all lines at once: label probabilities of each word, expected transition counts."""
        n, longest, k = score.shape
        e, t = np.exp(score - score.max(2, keepdims=True)), np.exp(moves)
        a, b = np.zeros_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, longest):
            step = (a[:, i - 1] @ t) * e[:, i]
            a[:, i] = np.where(mask[:, i, None], step / step.sum(1, keepdims=True), a[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = (b[:, i + 1] * e[:, i + 1]) @ t.T
            b[:, i] = np.where(mask[:, i + 1, None], step / step.sum(1, keepdims=True), 1)
        p = a * b
        p = p / p.sum(2, keepdims=True) * mask[..., None]
        both = a[:, :-1, :, None] * t * (b * e)[:, 1:, None, :]
        both = both / both.sum((2, 3), keepdims=True) * mask[:, 1:, None, None]
        return p, both.sum((0, 1))

    def scores(self, words: list[str]) -> np.ndarray:
        """Label scores of each word of one text, neighbours counted in."""
        rows = [[self.names[f] for f in shape_features(w) if f in self.names] for w in words]
        out = np.array([self.own[r].sum(0) for r in rows]).reshape(len(words), len(LABELS))
        out[1:] += np.array([self.prev[r].sum(0) for r in rows[:-1]]).reshape(-1, len(LABELS))
        out[:-1] += np.array([self.after[r].sum(0) for r in rows[1:]]).reshape(-1, len(LABELS))
        return out


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of a batch of chains (chains x words x labels); all of one length."""
    n, longest, k = score.shape
    best, back = score[:, 0], np.zeros((n, longest, k), np.int8)
    for t in range(1, longest):
        through = best[:, :, None] + moves
        back[:, t] = through.argmax(1)
        best = through.max(1) + score[:, t]
    out = np.zeros((n, longest), np.int8)
    out[:, -1] = best.argmax(1)
    for t in range(longest - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


class Tagger:
    """Labels of the words of many texts at once."""

    def __init__(self, field: Field, limit: int = 300_000):
        self.field, self.limit = field, limit
        self.kind_of: dict[str, int] = {}
        self.kinds: dict[tuple[int, ...], int] = {(): 0}  # 0 stands for a text's edge
        k = len(LABELS)
        self.own, self.prev, self.after = np.zeros((1, k)), np.zeros((1, k)), np.zeros((1, k))
        m = field.moves
        #: The most that another label than 0 can win on the transitions before and after a word.
        self.most = float((np.maximum(m[:, 1:] - m[:, :1], 0).max() + np.maximum(m[1:, :] - m[:1, :], 0).max()))

    def _learn(self, words: set[str]) -> None:
        rows = []
        for w in words:
            key = tuple(sorted(self.field.names[f] for f in shape_features(w) if f in self.field.names))
            if key not in self.kinds:
                self.kinds[key] = len(self.kinds)
                rows.append(list(key))
            self.kind_of[w] = self.kinds[key]
        if rows:
            f = self.field
            self.own, self.prev, self.after = (np.vstack([a, *(b[r].sum(0)[None] for r in rows)]) for a, b in ((self.own, f.own), (self.prev, f.prev), (self.after, f.after)))

    def label(self, many: list[list[str]]) -> list[dict[int, int]]:
        """For each text the words whose label isn't "other": position -> label."""
        if len(self.kind_of) > self.limit:
            self.kind_of.clear()
        if new := {w for x in many for w in x if w not in self.kind_of}:
            self._learn(new)
        get = self.kind_of.__getitem__
        flat = [0]
        first = []
        for x in many:
            first.append(len(flat))
            flat += map(get, x)
            flat.append(0)
        c = np.array(flat, np.int64)
        score = self.own[c]
        score[1:] += self.prev[c[:-1]]
        score[:-1] += self.after[c[1:]]
        score[c == 0] = 0
        open_ = (score[:, 1:].max(1) + self.most >= score[:, 0]) & (c != 0)
        at = np.flatnonzero(open_)
        out: list[dict[int, int]] = [{} for _ in many]
        if not len(at):
            return out
        begin = at[np.diff(at, prepend=-2) > 1]
        end = at[np.diff(at, append=at[-1] + 2) > 1] + 1
        owner = np.searchsorted(first, begin, "right") - 1
        moves = self.field.moves
        length = end - begin
        for n in np.unique(length):
            runs = np.flatnonzero(length == n)
            for some in np.array_split(runs, max(1, len(runs) * int(n) // 200_000)):
                where = begin[some][:, None] + np.arange(n)
                s = score[where].copy()
                # Certain words stand before and after a run, unless the text ends there.
                s[:, 0] += np.where((c[begin[some] - 1] != 0)[:, None], moves[0], 0)
                s[:, -1] += np.where((c[end[some]] != 0)[:, None], moves[:, 0], 0)
                got = viterbi(s, moves)
                for r, t in zip(*np.nonzero(got), strict=True):
                    d = owner[some[r]]
                    out[d][int(begin[some[r]] + t - first[d])] = int(got[r, t])
        return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field.train(LABELLED)


_EDGE = "\"'<>[]{},;:!?%*$&#|.="


def added_spans(text: str, labels: dict[int, int], base: list[Span]) -> list[Span]:
    """Spans of neighbouring words of one label, without signs at their edges; none that touches a base span."""
    if not labels:
        return []
    words = list(_SPACE.finditer(text))
    out: list[Span] = []
    for k in sorted(labels):
        s, e = words[k].span()
        if out and labels.get(k - 1) == labels[k] and labels[k] in (3, 4):  # only cards and phones take several words
            out[-1] = (out[-1][0], out[-1][1], e)
        else:
            out.append((LABELS[labels[k]], s, e))
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], [*accumulate((e for _, e in taken), max)]
    kept = []
    for kind, s, e in out:
        if kind == "secret" and "=" in text[s:e].rstrip("="):
            s += text[s:e].rstrip("=").rfind("=") + 1
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        before = bisect_left(starts, e)
        if s < e and not (before and reach[before - 1] > s):
            kept.append((kind, s, e))
    return kept


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """Each span, overlapping ones together, becomes its kind in capitals and brackets."""
    out, at = [], 0
    joined: list[Span] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if joined and s < joined[-1][2]:
            joined[-1] = (joined[-1][0], joined[-1][1], max(e, joined[-1][2]))
        else:
            joined.append((kind, s, e))
    for kind, s, e in joined:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())])


def _found(texts_: list[str | None], tagger: Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; so many are labelled at once as TOGETHER characters hold."""
    held: list[str] = []
    size = 0
    for k, t in enumerate(texts_, 1):
        held.append(t or "")
        size += len(held[-1])
        if size >= TOGETHER or k == len(texts_):
            for text, labels in zip(held, tagger.label([x.split() for x in held]), strict=True):
                base = base_spans(text)
                yield base, added_spans(text, labels, base)
            held, size = [], 0


def _tagger(field: Field) -> Tagger:
    """One for each Python worker: its cache serves all tasks that the worker gets."""
    return cached("pii", field.own.tobytes(), lambda: Tagger(field))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    Spans are kind:start:end in code points, by kind, then start. Null text is empty and has none; very long texts are read
    whole; a null id stays null; repeated rows give a row each; an empty table gives no rows; other columns play no part.
    """
    field = trained()

    def run(got):
        tagger = _tagger(field)
        for batch in got:
            rows = list(pairs(batch, "doc_id", "text"))
            yield from batches((_row(i, *f) for (i, _), f in zip(rows, _found([t for _, t in rows], tagger), strict=True)), FOUND)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _row(i: int | None, base: list[Span], added: list[Span]) -> tuple:
    return i, *(sum(s[0] == k for s in base) for k in KINDS[:4]), hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)


def redact_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with all spans of the text replaced; null texts stay null, clean and empty ones unchanged,
    very long ones are read whole. Repeated rows are changed alike, an empty table stays empty, other columns are passed on
    whatever their names."""
    field = trained()
    names = docs.columns
    at = names.index(text_col)

    def run(got):
        tagger = _tagger(field)
        for batch in got:
            given = batch.column(at).to_pylist()
            clean = [None if t is None else redact(t, b + a) if b or a else t for t, (b, a) in zip(given, _found(given, tagger), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

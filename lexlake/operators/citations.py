"""References to acts, articles and paragraphs in Italian prose.

A text becomes tokens (words, numbers, signs, with their places), and a small recogniser reads articles and acts from
them from left to right; binding then walks both lists once. A text without any word that could open a reference
isn't read at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import CODES, SUFFIXES

#: Names of codes whose act has another key than the name says, and further names.
NAMED_ACTS = {
    "codice di procedura penale": "dpr-447-1988",
    "codice procedura penale": "dpr-447-1988",
    "codice della strada": "dlgs-285-1992",
    "nuovo codice della strada": "dlgs-285-1992",
    "codice della navigazione": "rd-327-1942",
    "codice dei contratti pubblici": "dlgs-36-2023",
    "codice postale e delle telecomunicazioni": "dpr-156-1973",
    "codice del processo amministrativo": "dlgs-104-2010",
    "codice antimafia": "dlgs-159-2011",
    "codice privacy": "codice-privacy",
    "codice della privacy": "codice-privacy",
    "codice dell ambiente": "dlgs-152-2006",
    "codice di giustizia contabile": "dlgs-174-2016",
    "codice delle pari opportunita": "dlgs-198-2006",
    "codice del turismo": "dlgs-79-2011",
}
#: Abbreviations of codes; the short ones mean other things too and count only next to an article.
SHORT_CODES = {"c.c.": "codice-civile", "c.p.": "codice-penale", "c.p.c.": "codice-procedura-civile", "c.p.p.": "dpr-447-1988", "c.d.s.": "dlgs-285-1992", "cds": "dlgs-285-1992"}
LONG_CODES = {"cod. civ.": "codice-civile", "cod. pen.": "codice-penale", "cod. proc. civ.": "codice-procedura-civile", "cod. proc. pen.": "dpr-447-1988", "cod. nav.": "rd-327-1942"}
#: The constitution, known but not held: what cites it is dropped.
CONSTITUTION = ["cost.", "costituzione"]
#: Kinds of acts as they are written before a number and a year, with the prefix of the key.
ACT_KINDS = {
    "d.lgs.": "dlgs",
    "dlgs.": "dlgs",
    "d lgs.": "dlgs",
    "decreto legislativo": "dlgs",
    "d.p.c.m.": "dpcm",
    "dpcm": "dpcm",
    "d.p.r.": "dpr",
    "dpr": "dpr",
    "decreto del presidente della repubblica": "dpr",
    "d.l.": "dl",
    "dl.": "dl",
    "decreto legge": "dl",
    "r.d.": "rd",
    "rd": "rd",
    "regio decreto": "rd",
    "legge": "legge",
    "l.": "legge",
}
#: Types of those acts.
ACT_TYPE = {"dlgs": "decreto_legislativo", "dpcm": "dpcm", "dpr": "dpr", "dl": "decreto_legge", "rd": "regio_decreto", "legge": "legge"}
#: Ordinals of paragraphs.
ORDINALS = ["primo", "secondo", "terzo", "quarto", "quinto", "sesto", "settimo", "ottavo", "nono", "decimo"]
#: Stems of the nationalities whose codes are foreign.
FOREIGN = ("tedesc", "frances", "svizzer", "austriac", "spagnol", "europe", "ingles", "american", "statunitens", "olandes", "portoghes", "belg", "grec")
#: Prepositions that may stand between an article and its act, whole and elided.
PREPOSITIONS = {"del", "dello", "della", "dei", "delle", "degli", "di", "al", "allo", "alla", "ai", "nel", "nella"}
ELIDED = {"d", "all", "dell", "nell"}

ONE, MANY = {"art", "articolo"}, {"artt", "articoli"}
_SUFFIXES = frozenset(SUFFIXES)
_APOSTROPHES = ("'", "’")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
NAMES = {**dict(CODES), **NAMED_ACTS}


def plain(word: str) -> str:
    """Lower case, without accents."""
    low = word.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


class Tokens:
    """Words (lower case, without accents), numbers and signs of a text, with their places; past the end all are empty."""

    def __init__(self, text: str, without: Callable[[str], bool] | None = None):
        found = [(plain(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        if without:
            found = [t for t in found if not without(t[0])]
        self.words = [t[0] for t in found]
        self.starts, self.ends = [t[1] for t in found], [t[2] for t in found]

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def glued(self, k: int) -> bool:
        """No space between a token and the one before."""
        return 0 < k < len(self.words) and self.starts[k] == self.ends[k - 1]

    def skip(self, k: int, *signs: str) -> int:
        return k + 1 if self[k] in signs else k

    def number(self, k: int) -> tuple[str, int] | None:
        """N, N/M, N bis at a place: its normal form and the place after it."""
        if not self[k].isdecimal():
            return None
        value, k = self[k], k + 1
        if self[k] == "/" and self[k + 1].isdecimal():
            value, k = f"{value}/{self[k + 1]}", k + 2
        after = self.suffix(k)
        return (f"{value}-{self[after - 1]}", after) if after else (value, k)

    def suffix(self, k: int) -> int | None:
        """The place after a Latin suffix that is set off by a space, a dot or a hyphen."""
        at = k
        while self[at] in ("-", "."):
            at += 1
        return at + 1 if self[at] in _SUFFIXES and (at > k or not self.glued(at)) else None


class Phrases:
    """Written forms and what they stand for, found at a place by the longest first. The last dot of a form may be missing;
    words may have a hyphen or an apostrophe between them."""

    def __init__(self, forms: dict[str, object]):
        self.by_first: dict[str, list[tuple[list[str], object]]] = {}
        for form, value in forms.items():
            words = Tokens(form).words
            self.by_first.setdefault(words[0], []).append((words, value))
        for some in self.by_first.values():
            some.sort(key=lambda x: -len(x[0]))

    def at(self, t: Tokens, k: int) -> Iterator[tuple[int, object]]:
        """(place after the form, what it stands for)."""
        for words, value in self.by_first.get(t[k], ()):
            at = k + 1
            for word in words[1:-1] if words[-1] == "." else words[1:]:
                while word != "." and t[at] in ("-", *_APOSTROPHES):
                    at += 1
                if t[at] != word:
                    break
                at += 1
            else:
                yield t.skip(at, ".") if words[-1] == "." else at, value


_KINDS = Phrases(ACT_KINDS)
_CODES = Phrases({form: (key, near, form) for forms, near in ((SHORT_CODES, True), (LONG_CODES, False), (NAMES, False), (dict.fromkeys(CONSTITUTION), False)) for form, key in forms.items()})
_FIRST = frozenset((*_KINDS.by_first, *_CODES.by_first))
_OPENERS = re.compile(r"(?i)\b(?:artt?|articol[oi]|cod|codice|cost|costituzione|cds|legge|dlgs|dpcm|dpr|dl|rd|decreto|regio|nuovo|comma)\b|\b[cdlr]\s*\.|\bd\s+lgs\b")


@dataclass(frozen=True)
class Source:
    """Where a text names an act: places of its first token and after its last one."""

    start: int
    end: int
    key: str | None
    kind: str | None = None
    number: str | None = None
    year: int | None = None
    near: bool = False


@dataclass(frozen=True)
class Article:
    start: int
    end: int
    numbers: list[str]
    paragraph: str | None


def _is_year(x: str) -> bool:
    return len(x) == 4 and (x[:2] in ("18", "19") or x[:2] == "20")


def _numero(t: Tokens, k: int) -> int:
    """Past n., n°, num. or numero."""
    if t[k] in ("n", "num"):
        return t.skip(k + 1, ".", "°")
    return k + 1 if t[k] == "numero" else k


def _act_number(t: Tokens, k: int) -> tuple[str, int] | None:
    if not t[k].isdecimal() or len(t[k]) > 4:
        return None
    after = t.suffix(k + 1) if t[k + 1] != "." else None
    return (f"{t[k]}-{t[after - 1]}", after) if after else (t[k], k + 1)


def _numbered(t: Tokens, k: int) -> tuple[str, str, int] | None:
    """[, n.] number / year, or number del year, after a kind of act."""
    if not (got := _act_number(t, _numero(t, t.skip(k, ",")))):
        return None
    num, k = got
    if t[k] in ("/", "del") and _is_year(t[k + 1]):
        return num, t[k + 1], k + 2
    return None


def dated(months: list[str]) -> Callable[[Tokens, int], tuple[str, str, int] | None]:
    """[del] day month year [,] n. number, after a kind of act."""

    def form(t: Tokens, k: int) -> tuple[str, str, int] | None:
        k = t.skip(k, "del")
        if not (t[k].isdecimal() and len(t[k]) <= 2):
            return None
        k = t.skip(k + 1, "°")
        if t[k] not in months or not _is_year(t[k + 1]):
            return None
        year, k = t[k + 1], t.skip(k + 2, ",")
        if (after := _numero(t, k)) == k or not (got := _act_number(t, after)):
            return None
        return got[0], year, got[1]

    return form


def _source(t: Tokens, k: int, forms: tuple) -> Source | None:
    """The longest act that is named at a place."""
    found = []
    for at, prefix in _KINDS.at(t, k):
        if t[k] == "l" and (t[k + 1] != "." or (t[k - 1] == "." and t[k - 2].isalpha())):
            continue
        for form in forms:
            if got := form(t, at):
                num, year, end = got
                found.append(Source(k, end, f"{prefix}-{num}-{year}", ACT_TYPE[prefix], num, int(year)))
    if t[k - 1] != "." or not t.glued(k):
        for at, (key, near, form) in _CODES.at(t, k):
            if "." in form or len(form) < 4 or key is None:
                # A longer abbreviation goes on with a letter and a dot.
                dot = at if t[at - 1] == "." else t.skip(at, ".")
                if any(len(t[x]) == 1 and t[x].isalpha() and t[x + 1] == "." for x in {at, dot}):
                    continue
            elif t[at].startswith(FOREIGN):
                continue
            if form == "cost." and t[at - 1] != ".":
                continue
            found.append(Source(k, at, key, "codice" if key else None, near=near))
    return max(found, key=lambda s: s.end) if found else None


def sources(t: Tokens, forms: tuple = (_numbered,)) -> list[Source]:
    """Named acts from left to right, none over another."""
    out: list[Source] = []
    for k, word in enumerate(t.words):
        if word in _FIRST and not (out and k < out[-1].end) and (s := _source(t, k, forms)):
            out.append(s)
    return out


def _ends_list(t: Tokens, k: int) -> bool:
    """What shows that a number before still belongs to the list of a singular "art."."""
    w = t[k]
    if not w or w in ',;.:)]?!»"' or w in _APOSTROPHES or w in PREPOSITIONS or w in ("comma", "commi", "codice"):
        return True
    return (w in ELIDED and t[k + 1] in _APOSTROPHES) or (w in ("co", "c", "cod") and t[k + 1] == ".")


def _goes_on(t: Tokens, k: int) -> tuple[str, int] | None:
    """A further number of a singular "art.", after its comma or "e"; one with a suffix always is."""
    got = t.number(k)
    if not got:
        return None
    if "-" in got[0] or _ends_list(t, got[1]):
        return got
    return None


def _list(t: Tokens, k: int, free: bool) -> tuple[list[str], int] | None:
    """Numbers after art. or artt., and the place after them."""
    got = t.number(k)
    if not got:
        return None
    numbers, k = [got[0]], got[1]
    while t[k] in (",", ";", "e", "ed"):
        got = t.number(k + 1) if free else _goes_on(t, k + 1)
        if not got and not free and t[k] in (",", ";") and (mid := t.number(k + 1)) and t[mid[1]] in (",", ";", "e", "ed") and _goes_on(t, mid[1] + 1):
            got = mid
        if not got:
            break
        numbers.append(got[0])
        k = got[1]
    return numbers, k


def _paragraph(t: Tokens, k: int, ordinals: bool = True) -> tuple[str, int] | None:
    """[,] comma N, co. N, c. N, or an ordinal and "comma"."""
    k = t.skip(k, ",")
    if t[k] in ("comma", "commi"):
        return t.number(k + 1)
    if t[k] == "co" and t[k + 1] == "." or (ordinals and t[k] == "c" and t[k + 1] == "."):
        return t.number(k + 2)
    if ordinals and t[k] in ORDINALS and t[k + 1] == "comma":
        return str(ORDINALS.index(t[k]) + 1), k + 2
    return None


def articles(t: Tokens) -> list[Article]:
    out: list[Article] = []
    for k, word in enumerate(t.words):
        if (word in ONE or word in MANY) and not (out and k < out[-1].end) and (got := _list(t, t.skip(k + 1, "."), word in MANY)):
            numbers, end = got
            paragraph, end = _paragraph(t, end) or (None, end)
            out.append(Article(k, end, numbers, paragraph))
    return out


def _reaches(t: Tokens, k: int, to: int) -> bool:
    """Only commas, prepositions and "e N" stand between an article and an act."""
    while k < to:
        if t[k] in (",", ";") or t[k] in PREPOSITIONS:
            k += 1
        elif t[k] in ELIDED and t[k + 1] in _APOSTROPHES:
            k += 2
        elif t[k] in ("e", "ed") and t[k + 1].isdecimal():
            k += 2
            while t.glued(k) and (t[k].isalnum() or t[k] in ("/", "-")):
                k += 1
        else:
            return False
    return k == to


def _follows(t: Tokens, k: int, to: int) -> bool:
    """An article right after an act: signs only, and perhaps "all'"."""
    while k < to and t[k] in (",", ";", ":"):
        k += 1
    return k == to or (t[k] == "all" and t[k + 1] in _APOSTROPHES and k + 2 == to)


def found_references(t: Tokens, forms: tuple = (_numbered,)) -> list[dict]:
    """Explicit references in textual order, each once: act key, type, number, year, article, paragraph.

    An article belongs to the act that follows it across connectives only, unless another article has claimed that
    one; else to the act right before it. An article without act has no key. An act without article is a reference
    of its own, unless it is a short abbreviation. A list of several articles drops the paragraph.
    """
    named, claimed, out, ahead = sources(t, forms), set(), [], 0
    for a in articles(t):
        while ahead < len(named) and named[ahead].start < a.end:
            ahead += 1
        behind = ahead - 1
        while behind >= 0 and named[behind].end > a.start:
            behind -= 1
        at, paragraph = None, a.paragraph
        if ahead < len(named) and ahead not in claimed and _reaches(t, a.end, named[ahead].start):
            at = ahead
            if paragraph is None and (after := _paragraph(t, named[ahead].end, ordinals=False)):
                paragraph = after[0]
        elif behind >= 0 and _follows(t, named[behind].end, a.start):
            at = behind
        act = None
        if at is not None:
            claimed.add(at)
            act = named[at]
            if act.key is None:
                continue
        out += [(a.start, act, n, paragraph if len(a.numbers) == 1 else None) for n in a.numbers]
    out += [(s.start, s, None, None) for k, s in enumerate(named) if k not in claimed and s.key and not s.near]
    rows = [{"act_ref": act and act.key, "act_type": act and act.kind, "number": act and act.number, "year": act and act.year, "article": article, "comma": paragraph} for _, act, article, paragraph in sorted(out, key=lambda x: x[0])]
    return once(rows)


def once(rows: list[dict]) -> list[dict]:
    """The first row of each act, article and paragraph."""
    seen: dict[tuple, dict] = {}
    for r in rows:
        seen.setdefault((r["act_ref"], r["article"], r["comma"]), r)
    return [*seen.values()]


def references(text: str | None) -> list[dict]:
    """What found_references reads from a text; nothing of null and empty ones."""
    return found_references(Tokens(text)) if text and _OPENERS.search(text) else []


REFERENCE = "act_ref: string, act_type: string, number: string, year: int, article: string, comma: string"
_REFERENCES = pa.list_(pa.struct([("act_ref", pa.string()), ("act_type", pa.string()), ("number", pa.string()), ("year", pa.int32()), ("article", pa.string()), ("comma", pa.string())]))


def extractor(read: Callable[[str | None], list[dict]]):
    """A function of texts to arrays of references, in Arrow batches: matches need places and claims."""

    @F.arrow_udf(f"array<struct<{REFERENCE}>>")
    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([read(x) for x in texts.to_pylist()], _REFERENCES)

    return extract


def with_references(df: DataFrame, text_col: str, out: str = "refs") -> DataFrame:
    """Adds an array of the references in a text."""
    return df.withColumn(out, extractor(references)(F.col(text_col)))


def urn_parts(text: Column) -> Column:
    """The first link to an act of the state in a text: kind, year, date, number."""
    kind, day, number = r"([a-z][a-z.]*)", r"(\d{4})(?:-(\d{2})-(\d{2}))?", r"(\d+(?:-[a-z0-9]+)?)"
    pattern = f"(?i)urn:nir:stato:{kind}:{day};{number}"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("kind"), part(2).cast("int").alias("year"), F.make_date(part(2).cast("int"), part(3).cast("int"), part(4).cast("int")).alias("date"), F.lower(part(5)).alias("number"))

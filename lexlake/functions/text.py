"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import PARTITIONS


def without_accents(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without what isn't ASCII. Its function is a static method of ICU, which Spark ships."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(text.isNotNull(), F.regexp_replace(apart, r"[^\x00-\x7f]", ""))


def normalize_words(text: Column) -> Column:
    """Lower case without accents, dots dropped, all else but letters and digits to single spaces."""
    low = F.replace(F.lower(without_accents(text)), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.replace(normalize_words(text), F.lit(" "), F.lit("-"))


def anchor_slug(text: Column) -> Column:
    """Lower case, each run of other signs than letters and digits to a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate_words(text: Column, budget: int | Column) -> Column:
    """At most budget characters: cut at the last space within budget - 1 (or there, if none) and an ellipsis."""
    n = F.lit(budget) if isinstance(budget, int) else budget
    head = F.substr(text, F.lit(1), n - 1)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def snippet(text: Column, header: Column, width: int = 240) -> Column:
    """The text after its header, at most `width` characters cut at a word, trailing punctuation off, with an ellipsis."""
    body = F.trim(F.when(F.startswith(text, header), F.substr(text, F.length(header) + 1)).otherwise(text))
    head = F.substr(body, F.lit(1), F.lit(width))
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(body) <= width, body).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:.]+$", ""), F.lit("…")))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        size = 1024**k
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.floor(n * 10 / size) / 10)).otherwise(out)
    return out


def roman_value(roman: Column) -> Column:
    """Additive and subtractive numerals: a sign below its right neighbour counts against it."""
    signs = F.filter(F.split(F.upper(roman), ""), lambda c: c != "")
    value = F.create_map(*(F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair))
    each = F.transform(signs, lambda c: value[c])
    signed = F.zip_with(each, F.concat(F.slice(each, 2, 1 << 20), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(F.size(signs) == 0, 0).otherwise(F.aggregate(signed, F.lit(0), lambda s, x: s + x))


def blob_sha(content: Column) -> Column:
    """The object id that git gives the bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(2)), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.concat(F.lit("5"), F.substr(h, F.lit(14), F.lit(3))), F.concat(variant, F.substr(h, F.lit(19), F.lit(2))), F.substr(h, F.lit(21), F.lit(12)))


def token_estimate(chars: Column, per_token: float = 2.26) -> Column:
    """Half-even, as the reports round."""
    return F.bround(chars / per_token, 0).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def partition_label(label: Column) -> Column:
    """A partition heading whose opening kind and number are there twice, once: "CAPO II - CAPO II Premi" as "CAPO II Premi"."""
    words = F.split(label, r"\s+")
    number = F.substring_index(F.translate(words[1], ".", "-"), "-", 1)
    size = F.position(number, label, F.length(words[0]) + 1) - 1 + F.length(number)
    head, rest = F.substr(label, F.lit(1), size), F.ltrim(F.substr(label, size + 1))
    rest = F.when(F.startswith(rest, F.lit("-")), F.ltrim(F.substr(rest, F.lit(2)))).otherwise(rest)
    after = F.substr(rest, F.length(head) + 1, F.lit(1))
    twice = F.startswith(F.lower(rest), F.lower(head)) & (F.trim(F.translate(after, ".-", "  ")) == "")
    return F.when(F.upper(words[0]).isin(*PARTITIONS) & (number != "") & twice, rest).otherwise(label)


def gazette_code(word: Column) -> Column:
    """Whether a word is a gazette's code: two to four digits, a capital, four or five digits, perhaps a capital; or six or seven digits, a capital."""
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    shape = F.translate(F.translate(word, "012345678", "9" * 9), capitals, "A" * len(capitals))
    shapes = [f"{'9' * n}A{'9' * m}{end}" for n in (2, 3, 4) for m in (4, 5) for end in ("", "A")] + [f"{'9' * n}A" for n in (6, 7)]
    return shape.isin(*shapes)


#: Fixed value: a link of Markdown.
LINK = r"\[([^\]]*)\]\([^)]*\)"


def _one_line(text: Column) -> Column:
    """Links as their words, white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, LINK, "$1"), r"\s+", " "))


def clean_title(title: Column) -> Column:
    """A title without brackets that hold just a gazette's code or a collection's year; null if nothing is left."""
    parts = F.split(_one_line(title), r"\(")

    def add(done: Column, part: Column) -> Column:
        words = F.trim(F.substring_index(part, ")", 1))
        year = F.when(F.startswith(words, F.lit("Raccolta ")), F.substr(words, F.lit(10)))
        dropped = F.contains(part, F.lit(")")) & (gazette_code(words) | F.coalesce(F.translate(year, "012345678", "9" * 9) == "9999", F.lit(False)))
        return F.when(dropped, F.concat(F.rtrim(done), F.substr(part, F.locate(")", part) + 1))).otherwise(F.concat(done, F.lit("("), part))

    return F.nullif(F.trim(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0], add)), F.lit(""))


def clean_rubric(rubric: Column) -> Column:
    """A rubric up to the bracket that says from which article it stems; null if nothing is left."""
    text = _one_line(rubric)
    # A bracket that opens with one of these words, at the end of which white space stands.
    at = F.array_min(F.filter(F.array(*(F.position(F.lit(f"({w} "), F.concat(text, F.lit(" "))) for w in ("Articolo", "Art.", "Artt."))), lambda k: k > 0))
    return F.nullif(F.trim(F.when(at.isNotNull(), F.substr(text, F.lit(1), at - 1)).otherwise(text)), F.lit(""))


def collapsed(text: Column, width: int = 120) -> Column:
    """On one line without control signs, cut to a width with an ellipsis: for reports."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"[\x00-\x1f]", "")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substr(flat, F.lit(1), F.lit(width - 1)), F.lit("…")))


def model_slug(name: Column) -> Column:
    """Letters and digits of a model's name, in lower case; a name without any fails the job."""
    s = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    return F.when(s == "", F.raise_error(F.concat(F.lit("no letter or digit in: "), name))).otherwise(s)


def chunk_anchor(chunk_id: Column, article: Column) -> Column:
    """Anchor of a chunk's article and occurrence; ids of another form give that of the article."""
    part = F.nullif(F.split_part(chunk_id, F.lit("#"), F.lit(2)), F.lit(""))
    return anchor_slug(F.coalesce(part, F.concat(F.lit("art-"), article)))


def context_block(chunk_id: Column, header: Column, text: Column) -> Column:
    """A hit as a model reads it: a line with id and header, then the text, whose own header is not repeated."""
    own = F.startswith(text, header) & (header != "")
    body = F.when(own, F.regexp_replace(F.substr(text, F.length(header) + 1), r"^\n+", "")).otherwise(text)
    return F.concat(F.lit("--- ["), chunk_id, F.lit("] "), header, F.lit("\n"), body)


def age_in_days(now: Column, then: Column) -> tuple[Column, Column]:
    """Days between two times, exact and rounded up for display."""
    days = (F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000
    return days, F.ceil(days).cast("long")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def amendment_marks(text: Column) -> Column:
    """How many double brackets, open or closed, mark amended words."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[(]{2}|[)]{2}"), F.lit(0)))


def wholly_amended(paragraphs: Column) -> Column:
    """The first paragraph with text opens with "((" and the last one closes with "))"."""
    some = F.filter(paragraphs, lambda x: F.trim(x) != "")
    first, last = F.try_element_at(some, F.lit(1)), F.try_element_at(some, F.lit(-1))
    return F.coalesce(((F.trim(first) == "((") | F.startswith(first, F.lit("(("))) & F.endswith(F.trim(last), F.lit("))")), F.lit(False))


def self_numbered(number: Column, text: Column) -> Column:
    """A text that opens with its paragraph's own number and a dot or bracket, after an amendment's mark or not.

    A number is digits, then perhaps words after hyphens.
    """
    letters = "".join(map(chr, (*range(ord("a"), ord("z") + 1), *range(ord("à"), ord("ú") + 1))))
    own = F.lower(F.trim(number))
    parts = F.split(own, "-")
    digits = (parts[0] != "") & (F.translate(parts[0], "0123456789", "") == "")
    words = F.forall(F.slice(parts, 2, F.size(parts)), lambda w: (w != "") & (F.translate(w, letters, "") == ""))
    opened = _stripped(F.lower(text))
    opened = F.when(F.startswith(opened, F.lit("((")), _stripped(F.substr(opened, F.lit(3)))).otherwise(opened)
    sign = F.substr(_stripped(F.substr(opened, F.length(own) + 1)), F.lit(1), F.lit(1))
    return F.coalesce(digits & words & F.startswith(opened, own) & sign.isin(".", ")"), F.lit(False))


def _stripped(text: Column) -> Column:
    """Without white space at its start."""
    return F.ltrim(text, F.lit(" \t\n\r\v\f\u00a0"))


def open_links(text: Column) -> Column:
    """Addresses of the links of a text that may be opened: http and https, of 2048 characters at most."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\][(](https?://[^\s)]{1,2048})[)]"), F.lit(1))

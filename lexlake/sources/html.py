"""Articles and links from lenient HTML, by the standard library's parser in Arrow batches. A page that can't be read is an error row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.dims import SUFFIX_PATTERN

#: Fixed values: (tag, class) of the elements whose text is captured, and what they hold.
CAPTURES = {
    ("h1", "tipo-numero-data-akn"): "title",
    ("h2", "titolo-atto-akn"): "subtitle",
    ("h2", "article-num-akn"): "number",
    ("div", "attachment-name"): "attachment",
    ("span", "art-just-text-akn"): "text",
    ("span", "attachment-just-text"): "text",
    ("div", "art_aggiornamento-akn"): "text",
}
#: Elements without an end tag, and those whose text is not shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "noscript"}


#: Characters times unfinished tags up to which a page is parsed: the parser looks for the end of each from where it starts.
MOST_SEARCHED = 50_000_000
_OPENS = re.compile(r"<(?:(!--)|(script|style)(?=[\s/>]))?", re.IGNORECASE)


def unfinished_tags(html: str) -> int:
    """How many tags no ">" ends before the next "<", outside of comments, scripts and styles; in one walk over the page."""
    count, at, ends = 0, 0, html.find(">")
    low = html.lower()
    while m := _OPENS.search(html, at):
        at = m.end()
        if m[1]:
            at = html.find("-->", at)
        elif m[2]:
            at = low.find(f"</{m[2].lower()}", at)
        else:
            if 0 <= ends < at:
                ends = html.find(">", at)
            following = html.find("<", at)
            count += ends < 0 or 0 <= following < ends
            at = following
        if at < 0:
            break
    return count


def attempt(parse: Callable[[str], object], html: str | None) -> tuple[object | None, str | None]:
    """(what parse makes of a page, None), or (None, what went wrong): one page never stops the others."""
    try:
        n = unfinished_tags(html or "")
        if n * len(html or "") > MOST_SEARCHED:
            raise ValueError(f"{n} unfinished tags")
        return parse(html or ""), None
    except Exception as e:  # whatever a parser raises on broken markup is this page's result
        return None, f"{type(e).__name__}: {e}"[:200]


class Captures(HTMLParser):
    """Text of the elements in CAPTURES, in order. Elements of one tag nest; a captured element that starts inside another
    closes it, as they are siblings whose end is missing; what is open at the end counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.kind = self.tag = None
        self.depth = 0
        self.parts: list[str] = []

    def close_capture(self) -> None:
        if self.kind:
            self.found.append((self.kind, "".join(self.parts)))
        self.kind, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        kinds = [k for c in (dict(attrs).get("class") or "").split() if (k := CAPTURES.get((tag, c)))]
        if kinds:
            self.close_capture()
            self.kind, self.tag, self.depth = kinds[0], tag, 1
        elif self.kind:
            if tag == self.tag:
                self.depth += 1
            if tag == "br":
                self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag == "br" and self.kind:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.kind and tag == self.tag:
            self.depth -= 1
            if not self.depth:
                self.close_capture()

    def handle_data(self, data):
        if self.kind:
            self.parts.append(data)

    def done(self) -> list[tuple[str, str]]:
        self.close()
        self.close_capture()
        return self.found


class Visible(HTMLParser):
    """Title, shown text and link targets of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.text: list[str] = []
        self.links = 0
        self.silent = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        self.in_title = tag == "title" or (self.in_title and tag in VOID)
        self.links += tag == "a" and bool(dict(attrs).get("href"))

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)


_NUMBER = rf"(\d+(?:/\d+)?)(?:[ .-]+({SUFFIX_PATTERN}))?"
_HEADING = re.compile(rf"(?i)art\.?\s*{_NUMBER}\.?")
_ATTACHED = re.compile(rf"(\S.*?)-art\.\s+{_NUMBER}")


def _number(m: re.Match, at: int) -> str:
    return f"{m[at]}-{m[at + 1].lower()}" if m[at + 1] else m[at]


def _lines(parts: list[str]) -> str:
    return "\n".join(x.strip() for x in "".join(parts).split("\n")).strip()


def act_of(html: str | None) -> dict:
    """Title, subtitle and articles (number, annex, text, warning) of a captured page.

    An article's heading is "Art. N", an attachment's "NAME-art. N", whose name is the annex. Headings of other forms are
    the number as they stand, with a warning. The first title and subtitle count. Text before any article is lost unless
    there is none at all: then it is that of one article, "unico".
    """
    reader, out, before = Captures(), [], []
    head: dict[str, str | None] = {"title": None, "subtitle": None}
    reader.feed(html or "")
    for kind, text in reader.done():
        flat = " ".join(text.split())
        if kind in head:
            head[kind] = flat if head[kind] is None else head[kind]
        elif kind == "number":
            m = _HEADING.fullmatch(flat)
            out.append({"number": _number(m, 1) if m else text.strip(), "annex": None, "parts": [], "warning": None if m else "another heading"})
        elif kind == "attachment":
            m = _ATTACHED.fullmatch(flat)
            out.append({"number": _number(m, 2) if m else flat, "annex": m[1] if m else None, "parts": [], "warning": None if m else "another heading"})
        else:
            (out[-1]["parts"] if out else before).append(text)
    if not out:
        out = [{"number": "unico", "annex": None, "parts": before, "warning": None}]
    return head | {"articles": [{"number": a["number"], "annex": a["annex"], "text": _lines(a["parts"]), "warning": a["warning"]} for a in out]}


def contents_of(html: str) -> dict:
    v = Visible()
    v.feed(html)
    v.close()
    shown = " ".join("".join(v.text).split())
    return {"title": " ".join("".join(v.title).split()), "text_chars": len(shown), "words": len(shown.split()), "links": v.links}


def _parsed(pages: DataFrame, id_col: str, html_col: str, parse: Callable[[str], list[dict]], columns: str) -> DataFrame:
    """id, the columns of each row that parse gives for a page, and error; a page that can't be parsed has one row, of its error."""
    kind = pages.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, {columns}, error string"

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            rows: list[dict] = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, error = attempt(parse, html)
                rows += [{"id": i, "error": error}] if error is not None else [{"id": i} | r for r in found]
                if len(rows) >= 2048:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, ddl)


def page_contents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text_chars, words, links, error) of each page; a null one is empty, one that can't be parsed has only id and error."""
    return _parsed(pages, id_col, html_col, lambda html: [contents_of(html)], "title string, text_chars long, words long, links long")


def captured_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, subtitle, pos, number, annex, text, warning, error): a row for each article of each page, null counting as empty; of a
    page that can't be parsed, one row with its error."""

    def rows(html: str) -> list[dict]:
        act = act_of(html)
        return [{"title": act["title"], "subtitle": act["subtitle"], "pos": k} | a for k, a in enumerate(act["articles"])]

    return _parsed(pages, id_col, html_col, rows, "title string, subtitle string, pos long, number string, annex string, text string, warning string")


def html_articles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The articles of captured_pages, without the pages that have errors."""
    return captured_pages(pages, id_col, html_col).where("error is null").drop("error")


def dead_letters(parsed: DataFrame, stage: str) -> DataFrame:
    """(stage, id, error) of the rows that a stage could not read: what is to be looked at, and read again, apart from the rest."""
    return parsed.where("error is not null").select(F.lit(stage).alias("stage"), "id", "error")

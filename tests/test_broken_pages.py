"""Pages that a parser rejects or that would hold it up: one row of an error each, within bounded time."""

import base64
import time

import pytest

from lexlake.operators import bootstrap as bs
from lexlake.sources import html

GOOD = '<h1 class="tipo-numero-data-akn">LEGGE 7 agosto 1990, n. 241</h1><h2 class="article-num-akn">Art. 1</h2><span class="art-just-text-akn">Uno.</span>'
REJECTED, ENDLESS = "<![foo[" + GOOD, "<a " * 350_000


@pytest.mark.parametrize(("page", "n"), [("", 0), ("<p>a</p>", 0), ("a < b <p>", 1), ("<a <a <a", 3), ("<!-- < < < --><p>", 0), ("<script>if (a<b<c) {}</script><i>", 0), ("<SCRIPT >a<b</script><i>", 0), ("<script>a<b", 0), ("<style/>a<b</style", 1), ("<scripted <b>", 1), ("<", 1), ("<a>" * 5 + "<b", 1)])
def test_unfinished_tags(page, n):
    assert html.unfinished_tags(page) == n


def test_attempts_are_bounded():
    began = time.time()
    assert html.attempt(html.act_of, ENDLESS) == (None, "ValueError: 350000 unfinished tags")
    assert html.attempt(html.act_of, REJECTED)[1].startswith("AssertionError")
    assert html.attempt(html.contents_of, "<p " + "x" * 1_000_000)[1] is None
    assert html.attempt(html.act_of, "<p>" + "testo < 3 " * 20 + "</p>")[1] is None
    assert time.time() - began < 3


def test_pages(spark):
    rows = [(1, GOOD), (2, REJECTED), (3, ENDLESS), (4, None), (5, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.id: r for r in html.captured_pages(pages, "page_id", "html").collect()}
    assert {k: r.error and r.error.split(":")[0] for k, r in got.items()} == {1: None, 2: "AssertionError", 3: "ValueError", 4: None, 5: None}
    assert got[1].number == "1" and got[1].text == "Uno." and got[4].number == "unico" and got[2].number is None
    assert sorted(r.id for r in html.html_articles(pages, "page_id", "html").collect()) == [1, 4, 5]
    assert sorted((r.stage, r.id) for r in html.dead_letters(html.captured_pages(pages, "page_id", "html"), "pages").collect()) == [("pages", 2), ("pages", 3)]
    shown = {r.id: (r.words, r.error is None) for r in html.page_contents(pages).collect()}
    assert shown == {1: (7, True), 2: (None, False), 3: (None, False), 4: (0, True), 5: (0, True)}


def test_contents_of_pages_by_hand(spark):
    page = "<html><head><title> A  title </title><style>p {}</style></head><body><p>Two words</p><script>no()</script><a href='/x'>link</a><a>none</a></body>"
    (row,) = html.page_contents(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert tuple(row) == (1, "A title", len("Two wordslinknone"), 2, 1, None)


def test_a_broken_page_fails_alone(spark):
    """In a bootstrap the file has failed with what the parser said; the others are processed."""
    coded = lambda page: base64.b64encode(f"<html>{page}".encode()).decode()
    rows = [("DPR/a.md", coded(GOOD)), ("DPR/b.md", coded(REJECTED)), ("DPR/c.md", coded(ENDLESS))]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("path", "'DPR' as collection", "text", "md5(text) as sha")
    run = bs.bootstrap(df, df.select("path", "sha").limit(0))
    got = {r.path: (r.outcome, (r.error or "").split(":")[0]) for r in run["files"].collect()}
    assert got["DPR/b.md"] == ("failed", "AssertionError") and got["DPR/c.md"] == ("failed", "ValueError") and got["DPR/a.md"][0] == "processed"

"""Grammar tables, parsing and streaming on authored texts."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexlake.functions import text as tx
from lexlake.operators import chunking, identity, ingestion, parsing
from lexlake.sources import files, html
from lexlake.streaming import limits
from lexlake.streaming.markers import LONGEST, MarkerParser, marker_acts, parsed_marker, segments, split_streams, stateful_markers

def test_markers_keep_every_byte():
    text = "a [[dlgs-81-2008|art.18]] b [[x [ [[legge-241-1990|art.2]] [[" + "y" * (LONGEST + 50) + "]] tail ["
    whole = MarkerParser()
    want = [*whole.feed(text), *whole.finish()]
    n = sum(k == "marker" for k, _ in want)
    draw = random.Random(5)
    for _ in range(50):
        parser, got, at = MarkerParser(), [], 0
        while at < len(text):
            step = draw.randint(1, 9)
            got += parser.feed(text[at : at + step])
            at += step
        got += parser.finish()
        assert "".join(p for _, p in got) == text
        assert sum(k == "marker" for k, _ in got) == n


@pytest.mark.parametrize("marker,want", [
    ("[[dlgs-81-2008|art.18|c.1]]", ("dlgs-81-2008", "18", "1")),
    ("[[codice-civile|art.2043]]", ("codice-civile", "2043", None)),
    ("[[codice-civile|art.54|c.3|lett.a]]", ("codice-civile", "54", "3")),
    ("[[codice-civile|art.54|lett.a]]", ("codice-civile", "54", None)),
    ("[[codice-civile|art.54-bis|c.2-ter]]", ("codice-civile", "54-bis", "2-ter")),
    ("[[Codice|art.1]]", (None, None, None)),
    ("[[codice-civile|art.]]", (None, None, None)),
    ("[[codice-civile|art.1||x]]", (None, None, None)),
    ("[[codice-civile|art.1 bis]]", (None, None, None)),
    ("[[codice-civile]]", (None, None, None)),
    ("[[x [[codice-civile|art.1]]", (None, None, None)),
])
def test_marker_grammar(marker, want):
    assert tuple(parsed_marker(marker).values()) == want


@pytest.mark.parametrize("n", [199, 200, 201, 202])
def test_longest_marker(n):
    marker = "[[" + "x" * (n - 4) + "]]"
    parser = MarkerParser()
    got = [*parser.feed(marker), *parser.finish()]
    assert [k for k, _ in got] == (["marker"] if n <= LONGEST else ["text", "text"]) and "".join(p for _, p in got) == marker


def test_marker_acts(spark):
    df = spark.createDataFrame([("a [[legge-1-2000]] [[x-1|art.2]] [[x-1|c]] [[ no]]",)], "t string")
    assert df.select(marker_acts(F.col("t"))).first()[0] == ["x-1"]


@pytest.mark.parametrize("text,want", [
    ("a [[x|art.1]] b", [("text", "a "), ("marker", "[[x|art.1]]"), ("text", " b")]),
    ("a [[no]] b [[x|ar", [("text", "a [[no]] b "), ("pending", "[[x|ar")]),
    ("[[x|art.1|c.2]", [("pending", "[[x|art.1|c.2]")]),
    ("[[ no [[x-", [("text", "[[ no "), ("pending", "[[x-")]),
    ("[[x|com", [("text", "[[x|com")]),
    ("[[x|art.1||", [("text", "[[x|art.1||")]),
    ("[[" + "x" * 300, [("text", "[[" + "x" * 300)]),
    ("", []),
])
def test_segments_of_growing_text(text, want):
    assert segments(text) == want


def test_stateful_markers_equal_batch(spark, tmp_path):
    rows = [("a", k, t, k == 3) for k, t in enumerate(["x [", "[legge-1-20", "00|art.1]] y", " z"])] + [("b", 0, "[[open", True)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, delta string, is_end boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful_markers(stream).writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    joined = lambda d: sorted((r.stream_id, r.kind, r.payload) for r in d.collect() if r.kind == "marker")
    assert joined(spark.table("parts")) == joined(split_streams(df.drop("is_end"))) == [("a", "marker", "[[legge-1-2000|art.1]]")]


def test_line_events(spark):
    text = "Titolo\nlungo\n====\n\n### Art. 1\n----\ncorpo\n\nCAPO I\n---\nArt. 2-bis\n---\n1. uno\n"
    got = [(r.kind, r.payload) for r in parsing.line_events(parsing.lines(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")).orderBy("line_no").collect()]
    assert got == [("h1", "Titolo lungo"), ("blank", ""), ("atx", "### Art. 1"), ("line", "corpo"), ("blank", ""), ("h2", "CAPO I"), ("h2", "Art. 2-bis"), ("line", "1. uno"), ("blank", "")]


def test_articles(spark):
    text = "### Art. 1\ncorpo\n\nCAPO I\n---\nArt. 2-bis\n---\n1. uno\nNOME-art. 3\ndue"
    df = spark.createDataFrame([(1, text), (2, "solo testo")], "id long, t string")
    got = [(r.doc, r.number, r.style, r.path, r.body.strip()) for r in parsing.articles(parsing.line_events(parsing.lines(df, "id", "t"))).orderBy("doc", "article_no").collect()]
    assert got == [(1, "1", "atx", "", "corpo"), (1, "2-bis", "setext", "CAPO I", "1. uno"), (1, "3", "plain", "CAPO I — NOME", "due"), (2, "unico", "none", "", "solo testo")]


def test_paragraphs_equal_fold(spark):
    draw = random.Random(2)
    rows, want = [], []
    for doc in range(60):
        last, found = (0, 0), []
        for n in range(1, draw.randint(2, 15)):
            key = (draw.randint(0, 9), draw.choice([0, 0, 1, 2]))
            rows.append((doc, n, f"{key[0]}{['', '-bis', '-ter'][key[1]]}. x"))
            if key > last:
                last = key
                found.append(f"{key[0]}{['', '-bis', '-ter'][key[1]]}")
        want += [(doc, x) for x in found]
    df = spark.createDataFrame(rows, "doc long, line_no long, line string")
    got = [(r.doc, r.number) for r in parsing.paragraphs(df).where("number is not null").orderBy("doc", "paragraph_no").collect()]
    assert got == want


def test_overlapping_groups():
    draw = random.Random(4)
    for _ in range(3000):
        sizes = [draw.randint(1, 7600) for _ in range(draw.randint(1, 30))]
        groups = chunking.overlapping_groups(sizes)
        assert groups[0][0] == 0 and groups[-1][1] == len(sizes)
        for (a, b), (c, d) in zip(groups, groups[1:]):
            assert c in (b - 1, b) and a < c and b < d
        assert all(sum(sizes[a:b]) + 2 * (b - a - 1) <= chunking.MOST_BODY for a, b in groups)


def test_identity(spark):
    rows = [
        ("DECRETO LEGISLATIVO 2 gennaio 2018, n. 1 (18G00011)", None, None, "Codici/x.md", "dlgs-1-2018", "header"),
        ("DECRETO LEGISLATIVO 2 gennaio 2018, n. 1", "Codice della protezione civile.", None, "Codici/x.md", "codice-protezione-civile", "header"),
        ("REGIO DECRETO 4 marzo 1871, n. MMMDCCCLXXV", None, None, "Regi decreti/x.md", "rd-3875-1871", "header"),
        ("LEGGE 7 agosto 1990, n. 241 e successive modificazioni", None, None, "Leggi/x.md", "legge-241-1990", "header"),
        ("Codice di procedura penale", None, None, "Codici/x.md", "codice-procedura-penale", "header"),
        (None, "vedi urn:nir:stato:legge:1990;241!vig", None, "x/y.md", "legge-241-1990", "urn"),
        (None, None, "nulla", "x/2018-01-02_18G00011_ORIGINALE_V1.md", "gu-18g00011", "filename"),
        (None, None, None, "x/Atto vario.md", "decreto-atto-vario", "filename"),
    ]
    df = spark.createDataFrame(rows, "title string, subtitle string, first string, path string, want string, source string")
    for row in identity.with_identity(df, *map(F.col, ("title", "subtitle", "first", "path")), F.lit("decreto")).collect():
        assert (row.identity.act_ref, row.identity.source) == (row.want, row.source), row


def test_scalars(spark):
    df = spark.createDataFrame([("https://x#art-1",)], "s string")
    assert df.select(tx.uuid5_url(F.col("s"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://x#art-1"))


def test_payload_and_files(spark, tmp_path):
    import base64

    page = base64.b64encode(b"<html><body>ciao</body></html>").decode()
    for name, data in (("A/1.md", b"testo\x00\x00coda"), ("A/2.md", page.encode()), ("B/3.md", b"\xff\xfe broken"), (".h/4.md", b"x")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    df = files.read_files(spark, str(tmp_path))
    text = files.decoded(F.col("content"))
    kind, body = files.payload(text)
    got = {r.rel_path: (r.kind, r.body) for r in df.select("rel_path", kind.alias("kind"), body.alias("body")).collect()}
    assert got["A/1.md"] == ("markdown", "testo") and got["A/2.md"] == ("akn-html", "<html><body>ciao</body></html>") and set(got) == {"A/1.md", "A/2.md", "B/3.md"}
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path), ["C"])


def test_html_articles():
    page = """<div><h1 class="tipo-numero-data-akn">LEGGE
      1 marzo 2001, n. 5</h1><h1 class="tipo-numero-data-akn">other</h1><span class="art-just-text-akn">lost</span>
    <h2 class="article-num-akn">Art. 6 bis</h2><span class="a art-just-text-akn">uno<br/>due <span>tre</span> &amp; </span><b>no</b>
    <div class="art_aggiornamento-akn"><div>nota</div>fine</div><div class="attachment-name">ANNEX-art. 9/2</div><span class="attachment-just-text">aperto
    <h2 class="article-num-akn">Preambolo</h2><div class="attachment-name">TABELLA A</div>"""
    act = html.act_of(page)
    assert act["title"] == "LEGGE 1 marzo 2001, n. 5" and act["subtitle"] is None
    assert [tuple(a.values()) for a in act["articles"]] == [
        ("6-bis", None, "uno\ndue tre & notafine", None), ("9/2", "ANNEX", "aperto", None), ("Preambolo", None, "", "another heading"), ("TABELLA A", None, "", "another heading"),
    ]
    assert html.act_of(None)["articles"] == [{"number": "unico", "annex": None, "text": "", "warning": None}]
    assert html.act_of('<span class="art-just-text-akn">solo</span>')["articles"][0]["text"] == "solo"


def test_moves_pair_by_content(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path string, sha string")
    new = spark.createDataFrame([("x", "1"), ("c", "9"), ("e", "5")], "path string, sha string")
    got = sorted((r.status, r.path, r.old_path) for r in ingestion.snapshot_diff(old, new).collect())
    assert got == [("delete", "b", None), ("delete", "d", None), ("move", "x", "a"), ("upsert", "c", None), ("upsert", "e", None)]


def test_alerts_wait(spark):
    df = spark.createDataFrame([("k", 0, False), ("k", 10, True), ("k", 50, True), ("k", 110, True)], "k string, at long, ok boolean")
    assert [r.at for r in limits.sent_alerts(df, "k", F.col("at"), F.col("ok"), 100).collect()] == [10, 110]

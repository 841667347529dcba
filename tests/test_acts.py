"""Acts from files to chunks, on small fixtures and by brute force."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from lexlake.operators import bootstrap as bs
from lexlake.operators import chunking as ch
from lexlake.operators import parsing as pr
from lexlake.operators import validation as va
from lexlake.operators.ingestion import drop_progress, set_status

LONG = "parola " * 1000


def groups_by_hand(sizes, target=4500, most=7600):
    """One segment after the other, as the rule says it."""
    out, start = [], 0
    while True:
        end, held = start + 1, sizes[start]
        while end < len(sizes):
            grown = held + 2 + sizes[end]
            if grown > target and not (end == start + 1 and grown <= most):
                break
            held, end = grown, end + 1
        out.append((start, end))
        if end >= len(sizes):
            return out
        start = end - (sizes[end - 1] + 2 + sizes[end] <= most)


def test_overlapping_groups():
    draw = random.Random(4)
    for _ in range(3000):
        sizes = [draw.choice([draw.randint(1, 300), draw.randint(1, ch.MOST_BODY)]) for _ in range(draw.randint(1, 30))]
        got = ch.overlapping_groups(sizes)
        assert got == groups_by_hand(sizes)
        assert all(sum(sizes[a:b]) + 2 * (b - a - 1) <= ch.MOST_BODY for a, b in got)
    assert ch.overlapping_groups([]) == []


def test_oversized_pieces():
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(draw.choice(["a" * draw.randint(1, 9000), "\n", "\n\n", " b ", "\n \n"]) for _ in range(draw.randint(1, 20)))
        pieces = ch.oversized_pieces(text)
        assert all(len(p) <= ch.MOST_BODY for p in pieces)
        assert "".join("".join(pieces).split()) == "".join(text.split())
    assert ch.oversized_pieces("a" * 10_000) == ["a" * 4500, "a" * 4500, "a" * 1000]
    assert ch.oversized_pieces("x" * 4000 + "\ny\nz\n\n" + "w" * 4000) == ["x" * 4000 + "\ny\nz", "w" * 4000]


def test_article_bodies():
    assert ch.article_bodies([]) == [([], "")] and ch.article_bodies([("1", " "), (None, None)]) == [([], "")]
    assert ch.article_bodies([(None, "a\n\n\n\nb"), ("1", "c")]) == [(["1"], "a\n\nb\n\nc")]
    # The count takes all paragraphs, blank ones too; a lone long text is cut.
    many = ch.article_bodies([(str(k), "x" if k < 3 else "") for k in range(26)])
    assert many == [(["0", "1", "2"], "x\n\nx\n\nx")]
    assert [n for n, _ in ch.article_bodies([("1", LONG), ("2", LONG)])] == [["1"], ["2"]]
    assert [n for n, _ in ch.article_bodies([(None, "a" * 9000)])] == [[], []]


ACT = """LEGGE 7 agosto 1990, n. 241
====
Nuove norme
----
CAPO I
----
### Art. 1
Principi

1. Primo.
2. Secondo.
### Art. 2
1. Terzo.
N O T E
via
### Art. 1
Di nuovo.
"""
PAGE = '<html><h1 class="tipo-numero-data-akn">DECRETO LEGISLATIVO 9 aprile 2008, n. 81</h1><h2 class="article-num-akn">Art. 3</h2><span class="art-just-text-akn">1. Uno.<br>2. Due.</span></html>'


def files(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return df.select("path", F.substring_index("path", "/", 1).alias("collection"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("sha"))


def test_bootstrap(spark):
    rows = [
        ("A/1.md", ACT), ("Atti normativi abrogati (in originale)/1.md", ACT.replace("Primo", "Altro")), ("Codici/p.md", base64.b64encode(PAGE.encode()).decode()),
        ("DPR/solo nome.md", "solo testo"), ("DPR/rotto.md", None), ("DPR/fatto.md", "gia fatto"),
    ]
    df = files(spark, rows)
    out = bs.bootstrap(df, df.where("path = 'DPR/fatto.md'").select("path", "sha"))
    got = {r.path: (r.act_ref, r.outcome, r.error) for r in out["files"].collect()}
    assert got == {
        "A/1.md": ("legge-241-1990", "processed", None), "Atti normativi abrogati (in originale)/1.md": ("legge-241-1990", "duplicate", None), "Codici/p.md": ("dlgs-81-2008", "processed", None),
        "DPR/solo nome.md": ("dpr-solo-nome", "processed", None), "DPR/rotto.md": (None, "failed", "unreadable"), "DPR/fatto.md": (None, "resume_skipped", None),
    }
    acts = {r.act_ref: r for r in out["acts"].collect()}
    assert acts["legge-241-1990"].status == "abrogato" and acts["legge-241-1990"].file_path == "A/1.md" and acts["legge-241-1990"].title == "Nuove norme"
    chunks = {r.chunk_id: r for r in out["chunks"].collect()}
    assert sorted(chunks) == ["dlgs-81-2008#art-3#0", "dpr-solo-nome#art-unico#0", "legge-241-1990#art-1#0", "legge-241-1990#art-1.2#0", "legge-241-1990#art-2#0"]
    one = chunks["legge-241-1990#art-1#0"]
    assert one.header == "Legge 241/1990 — Nuove norme\nCAPO I\nArt. 1 — Principi" and one.text == f"{one.header}\n\n1. Primo.\n\n2. Secondo." and one.commi == ["1", "2"]
    assert chunks["legge-241-1990#art-2#0"].text.endswith("\n\n1. Terzo.") and chunks["legge-241-1990#art-1.2#0"].header.endswith("Art. 1 — Di nuovo.")
    assert chunks["dlgs-81-2008#art-3#0"].text == "Decreto Legislativo 81/2008 — DECRETO LEGISLATIVO 9 aprile 2008, n. 81\nArt. 3\n\n1. Uno.\n\n2. Due."
    assert chunks["dpr-solo-nome#art-unico#0"].text == "D.P.R.\nArticolo unico\n\nsolo testo"
    (total,) = bs.run_counts(out["files"]).collect()
    assert tuple(total) == (6, 3, 1, 1, 1)
    assert all(len(r.text) <= ch.MOST_TEXT for r in chunks.values())
    with pytest.raises(ValueError):
        bs.index_collection(df, df.select("path", "sha").limit(0), "Z")


def test_no_chunk_is_too_long(spark):
    text = "### Art. 1\nTitolo\n\n" + LONG + "\n\n" + "\n".join(f"{k}. {'testo ' * (k * 40)}" for k in range(1, 40)) + "\n### Art. 2\nTitolo\n\n" + "y" * 30_000
    out = bs.bootstrap(files(spark, [("Codici/x.md", text)]), files(spark, []).select("path", "sha"))
    rows = out["chunks"].collect()
    assert len(rows) > 20 and max(len(r.text) for r in rows) <= ch.MOST_TEXT
    assert any("parte 1/" in r.header for r in rows) and any("commi " in r.header for r in rows)


def test_delta_upserts(spark, tmp_path):
    first = files(spark, [("A/1.md", ACT), ("DPR/b.md", "solo testo")])
    run = bs.bootstrap(first, first.select("path", "sha").limit(0))
    paths = bs.write_run(run, str(tmp_path), "1")
    acts, chunks = spark.read.parquet(paths["acts"]), spark.read.parquet(paths["chunks"])
    new = files(spark, [("A/1.md", ACT.split("### Art. 2")[0]), ("DPR/b.md", "solo testo"), ("DL decaduti/9.md", ACT)])
    changes = spark.createDataFrame([("upsert", "A/1.md", None), ("upsert", "DL decaduti/9.md", None)], "status string, path string, old_path string")
    after = bs.delta_upserts(new, changes, acts, chunks)
    assert sorted(r.chunk_id for r in after["stale"].collect()) == ["legge-241-1990#art-1.2#0", "legge-241-1990#art-2#0"]
    assert sorted(r.chunk_id for r in after["chunks"].collect()) == ["dpr-b#art-unico#0", "legge-241-1990#art-1#0"]
    assert {r.act_ref: (r.status, r.file_path) for r in after["acts"].collect()} == {"legge-241-1990": ("decaduto", "A/1.md"), "dpr-b": ("vigente", "DPR/b.md")}


def test_runs(spark):
    runs = spark.createDataFrame([(1, "failed", "a"), (2, "running", None)], "id long, status string, commit_to string")
    with pytest.raises(ValueError):
        bs.required_watermark(runs)
    assert bs.required_watermark(runs.union(spark.createDataFrame([(3, "completed", "c")], runs.schema))) == "c"
    changes = spark.createDataFrame([("move", "b/1", "a/1"), ("delete", "a/2", None), ("upsert", "a/3", None)], "status string, path string, old_path string")
    left = drop_progress(spark.createDataFrame([("a/1",), ("a/2",), ("a/3",), ("b/1",)], "file_path string"), changes)
    assert sorted(r.file_path for r in left.collect()) == ["a/3", "b/1"]
    assert [r.status for r in bs.processing_order(changes).collect()] == ["delete", "move", "upsert"]
    acts = spark.createDataFrame([("x", "vigente", "1"), ("y", "vigente", "2")], "key string, status string, sha string")
    after, met = set_status(acts, spark.createDataFrame([("x", "abrogato", None), ("z", "abrogato", "3")], acts.schema))
    assert sorted(map(tuple, after.collect())) == [("x", "abrogato", "1"), ("y", "vigente", "2")] and met.first().n_rows == 1


def test_orphans_and_notes(spark):
    lines = pr.lines(spark.createDataFrame([(1, "sopra\n### Art. 1\nx\n# fuori\nancora\nNOME-art. 2\ny")], "id long, t string"), "id", "t")
    assert [tuple(r) for r in pr.orphan_text(pr.line_events(lines)).collect()] == [(1, "sopra\nancora")]
    noted = pr.lines(spark.createDataFrame([(1, "a\n N O T E \nb"), (2, "c\nN O T E x")], "id long, t string"), "id", "t")
    assert sorted((r.doc, r.line) for r in pr.cut_notes(noted).collect()) == [(1, "a"), (2, "N O T E x"), (2, "c")]


def census_by_hand(lines):
    """(level, text, setext) of each heading, line after line."""
    out, before, counted = [], None, False
    for line in lines:
        marks = len(line) - len(line.lstrip("#"))
        if 1 <= marks <= 6 and line[marks : marks + 1] == " " and line[marks + 1 :].strip():
            out.append((marks, line[marks + 1 :].rstrip(), False))
            before, counted = line, False
            continue
        bare = line.rstrip()
        level = 1 if bare and not bare.strip("=") else 2 if len(bare) > 1 and not bare.strip("-") else 0
        hit = bool(level and before and before.strip() and not counted)
        if hit:
            out.append((level, before.strip(), True))
        before, counted = line, hit
    return out


def test_census_by_hand(spark):
    draw = random.Random(5)
    docs = [(k, "\n".join(draw.choice(["===", "--", "-", "", "testo", "## due", "# ", "---  "]) for _ in range(draw.randint(1, 25)))) for k in range(200)]
    lines = pr.lines(spark.createDataFrame(docs, "id long, t string"), "id", "t")
    got = {}
    for r in pr.census_headings(lines).orderBy("doc", "line_no").collect():
        got.setdefault(r.doc, []).append((r.level, r.text, r.setext))
    assert got == {k: w for k, t in docs if (w := census_by_hand(t.split("\n")))}


def test_validation(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "assistant", "a"), (3, 0, "user", ""), (4, 0, "user", "x" * 8001), (5, 0, "system", "a"), (5, 1, "user", "b"), (7, 0, None, "x")] + [(6, k, "user", "a") for k in range(21)]
    got = {r.conv_id: r.reason for r in va.check_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: None, 2: "last_turn_not_user", 3: "empty_turn", 4: "turn_too_long", 5: "unknown_role", 6: "too_many_turns", 7: "unknown_role"}
    df = spark.createDataFrame([("a", 1), (" \u00a0", 1), (None, 1), ("a", 26), ("a", None)], "q string, k int")
    assert [r[0] for r in df.select(va.search_reason(F.col("q"), F.col("k"))).collect()] == [None, "blank_query", "blank_query", "k_out_of_range", "k_out_of_range"]
    with pytest.raises(Exception, match="blank query"):
        df.select(va.required_query(F.col("q"))).collect()

"""The stored index against scores computed document by document, and Italian terms by the published examples."""

import math
import pathlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake.functions import italian
from lexlake.operators import inverted as iv
from lexlake.plans import QUERIES

WORDS = re.compile(r"[^\W_]+")


def by_hand(docs, queries, k, analyse=lambda w: w, k1=1.2, b=0.75):
    """docs, queries: {id: text}; every document scored for every query."""
    of = lambda text: [t for w in WORDS.findall((text or "").lower()) if (t := analyse(w))]
    counts = {i: Counter(of(x)) for i, x in docs.items()}
    size = {i: sum(c.values()) for i, c in counts.items()}
    n, average = len(docs), sum(size.values()) / max(1, len(docs))
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, text in queries.items():
        score = {}
        for i, c in counts.items():
            some = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * size[i] / average)) for t in {*of(text)} if t in c]
            if some:
                score[i] = round(sum(some), 6)
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, i, s, r) for r, (i, s) in enumerate(best, 1)]
    return sorted(out)


def near(got, want):
    got = sorted(map(tuple, got))
    return [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))


def corpus(n, seed):
    draw = random.Random(seed)
    word = lambda: f"w{min(int(draw.expovariate(0.05)), 199)}"
    return {i: " ".join(word() for _ in range(draw.choice([3, 20, 80]))) + f" only{i}" for i in range(n)}


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, text string")


@pytest.mark.parametrize("part_docs", [7, 64, 1000])
@pytest.mark.parametrize("prune", [True, False])
def test_search_by_hand(spark, tmp_path, part_docs, prune):
    docs = corpus(400, part_docs)
    queries = {1: "w0 w1 w2", 2: "only7 w3", 3: docs[5], 4: "w150 w9 only399", 5: "nowhere", 6: ""}
    folder = str(tmp_path)
    iv.write_index(iv.blocks(table(spark, docs).repartition(3), "id", "text", part_docs=part_docs), folder, 4)
    asked = iv.asked_terms(table(spark, queries), "id", "text")
    got = iv.search(iv.read_index(spark, folder), asked, 10, prune=prune).collect()
    assert near(got, by_hand(docs, queries, 10))


def test_reads_the_asked_folders_only(spark, tmp_path):
    iv.write_index(iv.blocks(table(spark, corpus(50, 1)), "id", "text"), str(tmp_path), 16)
    index = iv.read_index(spark, str(tmp_path))
    assert index.where("bucket = 3").count() < index.count() / 4
    assert all(r.n == len(r.ids) == len(r.tfs) == len(r.lens) and r.max_tf == max(r.tfs) and r.min_len == min(r.lens) and r.ids == sorted(r.ids) for r in index.collect())


def test_an_index_after_changes_is_that_of_the_new_texts(spark, tmp_path):
    docs, folder = corpus(120, 4), str(tmp_path)
    iv.write_index(iv.blocks(table(spark, docs), "id", "text", part_docs=16), folder, 4)
    dead = None
    for step in range(3):
        draw = random.Random(step)
        feed = {i: draw.choice([None, f"w0 w{step} nuovo", docs.get(i)]) for i in draw.sample(range(150), 40)}
        added, gone = iv.updated(iv.read_index(spark, folder), dead, table(spark, feed), "id", "text")
        iv.write_index(added, folder, 4)
        dead = spark.createDataFrame(gone.collect(), gone.schema)
        docs |= feed
        docs = {i: x for i, x in docs.items() if x is not None}
        queries = {1: "w0 w1", 2: "nuovo", 3: "w20 w21 only3"}
        index = iv.living(iv.read_index(spark, folder), dead)
        assert near(iv.search(index, iv.asked_terms(table(spark, queries), "id", "text"), 10).collect(), by_hand(docs, queries, 10))
        assert iv.statistics(index).first().n == len(docs)


def test_edges(spark):
    docs = {1: None, 2: "", 3: "uno due", 4: "due due"}
    index = iv.blocks(table(spark, docs), "id", "text")
    asked = iv.asked_terms(table(spark, {1: "due", 2: None}), "id", "text")
    assert near(iv.search(index, asked, 3).collect(), by_hand(docs, {1: "due", 2: ""}, 3))
    assert iv.search(iv.blocks(table(spark, docs).limit(0), "id", "text"), asked, 3).collect() == []
    assert iv.search(index, asked.limit(0), 3).collect() == []
    assert iv.blocks(spark.createDataFrame([(None, "x")], "id long, text string"), "id", "text").where(F.col("term") != iv.ALL).count() == 0


def test_dead_documents_are_left_out_by_the_search(spark, tmp_path):
    """The same as a search of the living blocks, without writing these."""
    docs, folder = corpus(150, 9), str(tmp_path)
    iv.write_index(iv.blocks(table(spark, docs), "id", "text", part_docs=16), folder, 4)
    feed = {i: None if i % 3 else "w0 w1 nuovo" for i in range(0, 150, 2)}
    added, dead = iv.updated(iv.read_index(spark, folder), None, table(spark, feed), "id", "text")
    iv.write_index(added, folder, 4)
    docs = {i: x for i, x in (docs | feed).items() if x is not None}
    queries = {1: "w0 w1", 2: "nuovo w7", 3: "only4 w3", 4: docs[1]}
    got = iv.search(iv.read_index(spark, folder), iv.asked_terms(table(spark, queries), "id", "text"), 10, dead=dead).collect()
    assert near(got, by_hand(docs, queries, 10))


def written_by(spark, folder, run):
    """(result, bytes written to shuffles and to the tables below a folder)."""
    group = f"written-{random.random()}"
    tables = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    context, before = spark.sparkContext, tables()
    context.setJobGroup(group, group)
    out, n = run(), tables() - before
    context.setLocalProperty("spark.jobGroup.id", None)
    store, track = context._jsc.sc().statusStore(), context.statusTracker()
    for stage in {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}:
        try:
            n += store.lastStageAttempt(stage).shuffleWriteBytes()
        except Exception:  # noqa: BLE001
            assert track.getStageInfo(stage) is None  # skipped
    return out, n


@pytest.mark.parametrize("analyse", [None, italian.term])
def test_postings_are_not_written_for_each_block_of_queries(spark, tmp_path, monkeypatch, analyse):
    """Twenty-five blocks of queries instead of one: what a search writes stays nearly the same."""
    docs = corpus(2000, 3)
    iv.write_index(iv.blocks(table(spark, docs), "id", "text", analyse, part_docs=500), str(tmp_path), 4)
    queries = {i: " ".join(x.split()[:8]) for i, x in docs.items() if i % 20 == 0}
    asked = iv.stored(iv.asked_terms(table(spark, queries), "id", "text", analyse))
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    written, found = [], []
    for size in (1000, 4):
        monkeypatch.setattr(iv, "QUERIES", size)
        rows, n = written_by(spark, shared, lambda: iv.search(iv.read_index(spark, str(tmp_path)), asked, 3).collect())
        found.append(sorted(map(tuple, rows)))
        written.append(n)
    assert found[0] == found[1] and near(found[0], by_hand(docs, queries, 3, analyse or (lambda w: w)))
    assert 0 < written[1] < 2 * written[0], written


def test_hybrid_search_writes_postings_once(spark, monkeypatch):
    """A block for each query instead of one for all: nearly the same is written, and the same found."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    written, found = [], []
    for size in (1000, 1):
        monkeypatch.setattr(iv, "QUERIES", size)
        rows, n = written_by(spark, shared, lambda: QUERIES["hybrid_search"](spark, "/root/testdata/sf0.01").collect())
        found.append(sorted(map(tuple, rows)))
        written.append(n)
    assert len(found[0]) == 100 and found[0] == found[1]
    assert 0 < written[1] < 1.02 * written[0], written


def test_folders_without_terms(spark, tmp_path):
    """An index of few terms, the last of whose folders are empty."""
    docs = {1: "uno", 2: "uno due", 3: "tre"}
    iv.write_index(iv.blocks(table(spark, docs), "id", "text"), str(tmp_path), 64)
    index = iv.read_index(spark, str(tmp_path))
    assert index.agg(F.max("bucket")).first()[0] < 63
    asked = iv.asked_terms(table(spark, docs), "id", "text")
    assert near(iv.search(index, asked, 3).collect(), by_hand(docs, docs, 3))


def test_many_good_scores_and_ties(spark, monkeypatch):
    """More documents than a query keeps, with equal scores, by products of matrices alone, by single pairs alone, and in small steps."""
    draw = random.Random(2)
    docs = {i: " ".join(draw.choices(["a", "b", "c", "d"], k=3)) for i in range(300)}
    queries = {i: x for i, x in docs.items() if i % 10 == 0}
    want, index, asked = by_hand(docs, queries, 4), iv.blocks(table(spark, docs), "id", "text", part_docs=64), iv.asked_terms(table(spark, queries), "id", "text")
    for dense, pairs in ((64, 1 << 21), (10**9, 1 << 21), (0, 1 << 21), (0, 50)):
        monkeypatch.setattr(iv, "_DENSE", dense)
        monkeypatch.setattr(iv, "_PAIRS", pairs)
        assert near(iv.search(index, asked, 4).collect(), want)


def test_italian_stems():
    """Words of the published description and its sample vocabulary."""
    want = {
        "abbandonata": "abbandon", "abbandoneranno": "abbandon", "abbaruffato": "abbaruff", "abbassamento": "abbass", "abbassando": "abbass", "abbastanza": "abbast", "abbattere": "abbatt",
        "abbattimento": "abbatt", "pronto": "pront", "pronuncerà": "pronunc", "pronunciamento": "pronunc", "pronunciarsi": "pronunc", "propaganda": "propagand", "propongo": "propong",
        "proporzione": "proporzion", "proprio": "propr", "legge": "legg", "leggi": "legg", "quando": "quand",
    }
    assert {w: italian.stem(w) for w in want} == want
    stop = italian.stop_words()
    assert {"della", "nell", "che", "avremmo", "stessero", "nostra", "perché", "sugl"} <= stop and not {"legge", "articolo", "comma"} & stop
    assert all(w == w.lower() and w.isalpha() for w in stop)
    assert italian.term("della") is None and italian.term("articoli") == italian.term("articolo")
    for odd in ("", "a", "iu", "qu", "x" * 5000, "àèì", "straße"):
        assert isinstance(italian.stem(odd), str)


def test_italian_index(spark, tmp_path):
    """Both sides share the function: a query in other forms finds the same documents."""
    docs = {1: "La legge sulla proporzione degli articoli", 2: "le leggi e gli articoli delle proporzioni", 3: "nulla di tutto questo", 4: "decreto abbandonato"}
    queries = {1: "proporzioni dell'articolo", 2: "abbandonare i decreti", 3: "della nella"}
    index = iv.blocks(table(spark, docs), "id", "text", italian.term)
    got = iv.search(index, iv.asked_terms(table(spark, queries), "id", "text", italian.term), 5).collect()
    assert near(got, by_hand(docs, queries, 5, italian.term)) and {r.id for r in got if r.query_id == 1} == {1, 2}
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["bm25_italian"](spark, "/root/testdata/sf0.001").collect()
    assert near(got, by_hand(rows, {i: x for i, x in rows.items() if i % 100 == 0}, 10, italian.term))

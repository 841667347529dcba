"""The training-data operators against brute force, exact round trips, and the cases their docstrings define."""

import hashlib
import io
import random
import re
import time
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexlake.llm import bpe, components, fingerprints, media, packing, pii, quality, queries, simhash, substrings, token_files, toxicity, words

DATA = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "  ", "a  b\n\n c   d", "İstanbul ΑΣ Σ ΣΑΣ", "it's 'sad' don't", "x<|endoftext|>y <|startoftext|> z", "  x\x1cy\x85z", "naïve é é", "日本語 テスト 123 ４５", "a" * 5000, "ab" * 300 + " " + "1" * 500,
       "'S 'T I'LL", "\t\ttab \r\n x", "🙂🙂 👩‍👩‍👧", " lead", "trail ", "  <|endoftext|>  a", "ǅ ﬁ ² ½ Ⅷ", "!!'s ''t", "one. Two, three\nfour five.\nSix"]
EDGE = [(1, "a b c"), (1, "a b c"), (2, ""), (3, None), (None, "null id"), (None, None), (7, "word " * 30_000), (8, "Ünï " * 40), (9, "same text here"), (10, "same text here")]
OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, WORD),
    "packing": lambda d: packing.pack_documents(d, WORD),
    "media": media.text_media_features,
    "stored_media": media.text_media,
    "pii": pii.find_personal_data,
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.OrdinalModel({}, [1.0, 2.0])),
    "quality": lambda d: quality.score_quality(d, quality.fit(np.zeros((0, quality.N_STATISTICS)), np.zeros(0))),
    "simhash": simhash.near_duplicates,
    "substrings": substrings.dedup_digest,
    "fingerprints": fingerprints.fingerprint_edits,
    "classes": fingerprints.exact_classes,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def edge(spark, rows=EDGE):
    """With extra columns under names that the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in ("fp", "bucket", "kind", "tie", "_id", "label", "fingerprint", "id", "known")})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_cases(spark, name):
    out = OPERATORS[name](edge(spark)).collect()
    ids = [r.doc_id for r in out]
    if name == "packing":
        assert {*ids} == {1, 2, 3, None, 7, 8, 9, 10}
    else:
        assert sorted(ids, key=str) == sorted((i for i, _ in EDGE), key=str)
        same = [tuple(r)[1:] for r in out if r.doc_id in (9, 10)]
        if name in ("bpe", "media", "pii", "toxicity", "quality", "classes"):
            assert same[0] == same[1]
        one = [tuple(r) for r in out if r.doc_id == 1]
        assert one[0] == one[1]
    assert OPERATORS[name](edge(spark, [])).collect() == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_equal_library(path, rows):
    lib, spec, chunks = Tokenizer.from_file(path), bpe.SpeculativeBPE(path, limit=300), words.ChunkEncoder(path, limit=500)
    texts = ODD + [t for _, t in rows]
    for text, (ids, decoded) in zip(texts, spec.encode_many(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == words.packed(want) == chunks.encode(text)
        assert spec.encode(text) == want
        assert decoded == lib.decode(want, skip_special_tokens=False)


def test_speculation_fails_and_recovers(rows):
    spec = bpe.SpeculativeBPE(WORD)
    for _, t in rows[:20]:
        spec.encode(t)
    assert 0 < spec.failed <= spec.seen
    draw = random.Random(3)
    lib = Tokenizer.from_file(WORD)
    for _ in range(300):
        word = "".join(draw.choice("abcdeinorstth") for _ in range(draw.randint(1, 400)))
        assert spec.encode(word) == lib.encode(word, add_special_tokens=False).ids


def test_packing(spark, docs, rows):
    lib = Tokenizer.from_file(WORD)
    want = {i: np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    got = packing.pack_documents(docs, WORD).toPandas()
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert b"".join(g.ids) == want[i].tobytes() and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert [zlib.crc32(x) for x in g.ids] == g.ids_crc32.tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        n = g.length.sum()
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and (n == 2048 or n & (n - 1) == 0)


def test_packing_level_minimises_squares():
    draw = random.Random(1)
    p = packing.SumOfSquares(64, max_open=10_000)
    for _ in range(500):
        s = draw.randint(1, 63)
        before = p.filled.copy()

        def cost(h, s=s, before=before):
            f = before.copy()
            if h:
                f[h] -= 1
            if h + s < 64:
                f[h + s] += 1
            return (f**2).sum()

        options = [0, *(h for h in range(1, 65 - s) if before[h])]
        assert cost(p.level(s)) == min(map(cost, options))
        list(p.add((0, 0, bytes(4 * s), s)))
    assert p.n_open == p.filled.sum()


def test_packing_with_few_open_windows(spark, docs, rows):
    """The bound on open windows closes the fuller ones; every id stays in one piece, nothing is padded."""
    got = packing.pack_documents(docs.coalesce(1), WORD, max_open=6).toPandas()
    for _, g in got.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes == 2048).sum() >= len(sizes) - 11 and all(n & (n - 1) == 0 for n in sizes)


def test_bpe_digests(docs, rows):
    lib = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, WORD, digest=True).collect()}
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_token_files(spark, docs, rows):
    lib = Tokenizer.from_file(BYTE)
    manifest, folder = token_files.write_token_files(docs, BYTE)
    got = token_files.read_token_files(spark, manifest, folder).orderBy("start").collect()
    at = 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, t) in zip(got, rows, strict=True):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    empty = edge(spark, [])
    assert token_files.read_token_files(spark, *token_files.write_token_files(empty, BYTE)).count() == 0
    odd = token_files.read_token_files(spark, *token_files.write_token_files(edge(spark), BYTE)).orderBy("start").collect()
    assert [r.doc_id for r in odd] == sorted((i for i, _ in EDGE), key=lambda i: (i is not None, i or 0))


def test_documents_are_read_alone(spark, tmp_path):
    """Through head and index only; texts that are all long have a dictionary too."""
    df = spark.createDataFrame([(k, f"word{k} and more " * 3000) for k in range(12)], "doc_id long, text string")
    manifest, folder = token_files.write_token_files(df, BYTE, folder=f"file://{tmp_path}/tokens")
    (row,) = manifest.collect()
    lib = Tokenizer.from_file(BYTE)
    assert token_files.read_document(row.path, folder, 7).tolist() == [*lib.encode("word7 and more " * 3000, add_special_tokens=False).ids, 0]
    assert (tmp_path / "tokens" / "dictionary.zdict").stat().st_size > 0


def test_one_document_of_a_token_file():
    dictionary = token_files.train_dictionary([bytes(range(200)) * 3] * 5)
    press = zstandard.ZstdCompressor(dict_data=token_files.shared_dictionary(dictionary))
    ids = [np.arange(n, dtype="<u2") for n in (3, 0, 500)]
    data = token_files.write_file([(5, 3, press.compress(ids[0].tobytes())), (None, 0, press.compress(b"")), (9, 500, press.compress(ids[2].tobytes()))], 2, hashlib.sha256(dictionary).digest())
    f = token_files.TokenFile(data, dictionary)
    assert f.document(2).tolist() == ids[2].tolist() and f.document(1).tolist() == [] and f.known.tolist() == [1, 0, 1]
    with pytest.raises(ValueError):
        token_files.TokenFile(data, dictionary + b"x")


def test_media_formats():
    draw = np.random.default_rng(1)
    g, c = draw.integers(0, 256, (7, 13)).astype(np.uint8), draw.integers(0, 256, (7, 13, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert (media.decode(b"P3 # c\n2 1\n255\n1 2 3 4 5 6") == np.array([[[1, 2, 3], [4, 5, 6]]])).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == 1 - np.array([[1, 0, 1], [0, 1, 0]])).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == np.array([[0, 1, 0]])).all()
    for broken in (b"", b"P7", b"P5\n2 2\n255\nabc", b"BM", b"P2\n1", b"P2 1 1 255 300", b"P2 1 1 255 -1", b"P2 1 1 9 10", b"P3 1 1 255 1 2 999999999999999999999", b"P1 1 1 7", b"P5 1 1 70000 xx", b"P2 9999999 9999999 255 1"):
        with pytest.raises(ValueError):
            media.decode(broken)
    small = media.area_resize(g, 3, 5)
    fine = np.repeat(np.repeat(g.astype(float), 3, 0), 5, 1)
    assert np.allclose(small, fine.reshape(3, 7, 5, 13).mean((1, 3)))


def test_media_columns(spark):
    df = spark.createDataFrame([(1, media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))), (2, b"junk"), (3, None)], "image_id long, data binary")
    got = {r.id: r for r in media.media_tiles(df, "image_id", "data").collect()}
    assert got[1].height == 8 and got[1].error is None and got[2].tile is None and got[3].error
    assert np.load(__import__("io").BytesIO(got[1].tile)).shape == (32, 32)


def area_means(image, height, width):
    """Mean over each cell's exact area, sample by sample."""
    def share(n, cells, k):
        low, high = k * n / cells, (k + 1) * n / cells
        return [(j, min(high, j + 1) - max(low, j)) for j in range(int(low), min(n, int(np.ceil(high)))) if min(high, j + 1) > max(low, j)]

    h, w = image.shape
    rows_, cols = [share(h, height, k) for k in range(height)], [share(w, width, k) for k in range(width)]
    return [[sum(float(image[i, j]) * a * b for i, a in r for j, b in c) / (h / height * w / width) for c in cols] for r in rows_]


def test_text_media(docs, rows):
    got = {r.doc_id: r for r in media.text_media_features(docs).collect()}
    stored_ = {r.doc_id: bytes(r.media) for r in media.text_media(docs).collect()}
    for i, t in rows[:60]:
        raw = t.encode()
        full = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        image = np.frombuffer(full, np.uint8).reshape(-1, 64)
        cells = area_means(image, 8, 9)
        bits = "".join(str(int(round(cells[a][b + 1], 6) > round(cells[a][b], 6))) for a in range(8) for b in range(8))
        tile = np.load(io.BytesIO(r.tile))
        assert np.abs(tile - np.array(area_means(image, 32, 32))).max() <= 0.5 + 1e-6 and tile.dtype == np.uint8
        assert r.feature == f"{int(bits, 2):016x}:{zlib.crc32(r.tile):08x}"
        assert r.media_sha256 == hashlib.sha256(stored_[i]).hexdigest() and r.media_bytes == len(stored_[i]) and media.decode(stored_[i]).tobytes() == full


def base_by_patterns(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_patterns(rows):
    draw = random.Random(3)
    noise = ["".join(draw.choice("a@.1230+ -()_") for _ in range(draw.randint(0, 60))) for _ in range(5000)]
    for t in [*noise, "a@b.c_d@e.f x@y @@ a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1.2.3.4.5", *(t for _, t in rows)]:
        assert sorted(pii.base_spans(t)) == sorted(base_by_patterns(t))


def test_personal_data_columns(docs, rows):
    """Counts, digest and spans of the query against the patterns; added spans touch no base span."""
    for r in pii.find_personal_data(docs).collect():
        base = sorted(base_by_patterns(dict(rows)[r.doc_id]), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2])) and {*base} <= {*spans}
        assert all(b <= s or e <= a for _, s, e in {*spans} - {*base} for _, a, b in base)


@pytest.mark.parametrize("piece", ["1.", "a@", "a@b.c ", "+1 ", "1 ", "a", "+1 555 555 5555 x@y ", "9"])
def test_personal_data_in_linear_time(piece):
    tagger = pii.Tagger(pii.trained())

    def took(n):
        text = piece * (n // len(piece))
        began = time.process_time()
        pii.redact(text, sum(next(pii._found([text], tagger)), []))
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 0.5 + 30 * took(100_000)


def test_field_decodes_as_one_chain(rows):
    field, tagger = pii.trained(), pii.Tagger(pii.trained(), limit=50)
    many = [t.split() for _, t in rows]
    for given, found in zip(many, tagger.label(many), strict=True):
        if given:
            whole = pii.viterbi(field.scores(given)[None], field.moves)[0]
            assert found == {k: int(v) for k, v in enumerate(whole) if v}
    wrong = sum(a != b for w, y in pii.parse_labelled(pii.LABELLED) for a, b in zip(pii.viterbi(field.scores(w)[None], field.moves)[0].tolist(), y, strict=True))
    assert wrong <= 2
    text = 'call 916-555-6549 or mail max@intern about token = "ede43f42c939b6405768150e0411590525c"'
    (base, added), = pii._found([text], tagger)
    assert not base and {k for k, *_ in added} >= {"phone", "secret"}
    assert pii.redact("a@b.co x", [("email", 0, 6)]) == "[EMAIL] x"


def test_redaction_keeps_clean_rows(spark):
    df = edge(spark, [(1, "clean words only"), (2, "mail a.b@c.example.com now"), (3, None)])
    out = pii.redact_personal_data(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "clean words only", 2: "mail [EMAIL] now", 3: None}


def removed_by_brute_force(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted({*rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_substrings(spark, docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.dedup_digest(docs).collect()}
    assert got == removed_by_brute_force(rows)
    draw = random.Random(9)
    texts = [(k, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 90)))) for k in range(60)] + [(99, "x " * 50), (None, "x " * 25)]
    for w in (20, 9):
        got = {r.doc_id: tuple(r)[1:] for r in substrings.dedup_digest(spark.createDataFrame(texts, "doc_id long, text string"), window=w).collect()}
        assert got == removed_by_brute_force(texts, w)


def factors_by_brute_force(texts, window):
    """Greedy longest matches against the first places of all windows."""
    words = {i: t.split() for i, t in texts}
    first, out = {}, []
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    for i in sorted(words):
        at = lambda s: first.get(tuple(words[i][s : s + window])) if s + window <= len(words[i]) else None  # noqa: B023, E731
        p = 0
        while p + window <= len(words[i]):
            ref, k = at(p), 1
            if ref == (i, p):
                p += 1
                continue
            while at(p + k) == (ref[0], ref[1] + k):
                k += 1
            out.append((i, p, k - 1 + window, *ref))
            p += k
    return sorted(out)


def overlapping(draw, n):
    """Texts pieced together from passages, with edits, so that matches run over the ends of others."""
    stock = [[f"{draw.choice('abcd')}{draw.randint(0, 60)}" for _ in range(draw.randint(10, 60))] for _ in range(8)]
    out = []
    for k in range(n):
        words = [w for _ in range(draw.randint(0, 5)) for w in draw.choice(stock)]
        for j in draw.sample(range(len(words)), min(len(words), draw.randint(0, 2))):
            words[j] = f"e{k}"
        out.append((k, " ".join(words)))
    return out


def test_factors_are_greedy_and_longest(spark):
    texts = overlapping(random.Random(4), 80)
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in substrings.relative_factors(df).collect())
    assert got == factors_by_brute_force(texts, 20)


@pytest.mark.parametrize("fold", [1, 8 << 20])
def test_factors_over_many_blocks(spark, monkeypatch, fold):
    """Small chunks, blocks answered row by row: each factor is a match with an earlier text, together they are all repeats."""
    monkeypatch.setattr(substrings, "CHUNK_CHARS", 400)
    monkeypatch.setattr(substrings, "FOLD_BYTES", fold)
    texts = overlapping(random.Random(7), 120)
    words = {i: t.split() for i, t in texts}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    gone = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for i, s, n, j, at in map(tuple, substrings.relative_factors(df).collect()):
        assert n >= 20 and words[i][s : s + n] == words[j][at : at + n] and (j, at) < (i, s)
        gone[i][s : s + n] = True
    want = removed_by_brute_force(texts)
    assert {i: int(g.sum()) for i, g in gone.items()} == {i: w[1] for i, w in want.items()}
    assert {r.doc_id: tuple(r)[1:] for r in substrings.dedup_digest(df).collect()} == want


def test_repeats_are_cut(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    df = edge(spark, [(1, f"eins\n{passage}\tzwei"), (2, f"drei  {passage} vier\n"), (3, None), (4, "kept  as\nit is")])
    out = substrings.remove_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"eins\n{passage}\tzwei", 2: "drei  vier\n", 3: None, 4: "kept  as\nit is"}


def print_by_bits(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(prints):
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: print_by_bits(t) for i, t in rows}
    assert all(int(got[i].fingerprint, 16) == p for i, p in prints.items())
    assert {i: r.component_id for i, r in got.items()} == least_reachable(prints)


@pytest.mark.parametrize("block", [4096, 40])
def test_links_of_a_dense_group(spark, monkeypatch, block):
    """Hundreds of fingerprints a few bits apart: every connection, less links than pairs, hot keys cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(2)
    prints = {0: draw.getrandbits(64)}
    for k in range(1, 400):
        base = prints[draw.randrange(k)] if k % 50 else draw.getrandbits(64)
        for _ in range(draw.randint(1, 4)):
            base ^= 1 << draw.randrange(64)
        prints[k] = base
    fps = spark.createDataFrame([(simhash.signed(p),) for p in {*prints.values()}], "p long").repartition(3)
    links = simhash.near_links(fps)
    roots = {r.node: r.root for r in components.components(links).collect()}
    want = least_reachable(prints)
    sig = {k: roots.get(simhash.signed(p), simhash.signed(p)) for k, p in prints.items()}
    assert all((sig[a] == sig[b]) == (want[a] == want[b]) for a in prints for b in prints)


def test_golay_keys_meet():
    code, draw = simhash.Golay(), np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in draw.choice(64, draw.integers(0, 4), replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    found = []
    for fps in (a, b):
        own = {}
        for at, key, role in simhash.golay_keys(fps, code):
            for i, k in zip(at.tolist(), key.tolist(), strict=True):
                own.setdefault((i, role), set()).add(k)
        found.append(own)
    assert all(found[0][i, 0] & found[1][i, 1] for i in range(len(a)))


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (300, 200), (5, 5), (7, None), (1, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def canonical(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())).strip(" ")


def test_fingerprints(spark, docs, rows):
    text, ids = dict(rows), sorted((i for i, _ in rows), reverse=True)
    first = {}
    for i, t in rows:
        first.setdefault(canonical(t), i)
    for r in fingerprints.fingerprint_edits(docs).collect():
        t, nxt = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canonical(edited) == canonical(t)) and r.near_next == float(canonical(nxt) == canonical(t)) and r.class_id == first[canonical(t)]
    few = spark.createDataFrame([(1, "Straße  ﬁ Ａ\n"), (2, "strasse fi a"), (5, "É"), (9, "É "), (12, "x")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in fingerprints.exact_classes(few).collect()}
    assert got == {1: 1, 2: 1, 5: 5, 9: 5, 12: 12}


def test_equal_buckets_are_compared(spark, monkeypatch):
    """With a digest that says nothing, bytes still tell texts apart."""
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.concat(F.lit("same"), F.substring(c, 1, 0)))
    df = spark.createDataFrame([(4, "a"), (2, "b"), (9, "A"), (7, "b"), (1, "c")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in fingerprints.exact_classes(df).collect()} == {4: 4, 9: 4, 2: 2, 7: 2, 1: 1}


def labelled(sf, col):
    rows = duckdb.sql(f"SELECT text, {col}, doc_id FROM '/root/testdata/{sf}/documents.parquet' JOIN '/root/testdata/{sf}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    cut = [r for r in rows if zlib.crc32(str(r[2]).encode()) % 5], [r for r in rows if not zlib.crc32(str(r[2]).encode()) % 5]
    return ([(t, y) for t, y, _ in c] for c in cut)


def fitted(spark, rows):
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "doc_id long, text string, grade int")
    return toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "grade"))


def test_toxicity_on_held_out_rows(spark):
    train, held = labelled("sf0.1", "toxic")
    model = fitted(spark, train)
    assert model.cuts == sorted(model.cuts)
    got = [model.above(toxicity.words(t))[0] >= 0.5 for t, _ in held]
    hit = sum(g and y for g, (_, y) in zip(got, held, strict=True))
    assert hit / sum(y for _, y in held) > 0.8 and sum(g and not y for g, (_, y) in zip(got, held, strict=True)) < 0.01 * len(held)
    assert all(a >= b for t, _ in held[:200] for a, b in [model.above(toxicity.words(t))])


def grade_probability(s, cuts, k):
    """Of one document, by the definition of a cumulative link."""
    above = [1.0, *(1 / (1 + np.exp(c - s)) for c in cuts), 0.0]
    return above[k] - above[k + 1]


def test_ordinal_fit_is_the_least_of_its_likelihood():
    """Against the slopes of the plain dense likelihood, by differences: zero at the cuts, the penalty's at the weights."""
    draw = np.random.default_rng(4)
    n, d, grades, sparse = 400, 12, 4, 0.01
    x = draw.random((n, d)) * (draw.random((n, d)) < 0.5)
    y = np.digitize(x @ draw.normal(0, 3, d) * (np.arange(d) < 4).mean() + draw.logistic(0, 1, n), [0.0, 1.0, 2.5])
    row, column = np.nonzero(x)
    w, cuts = toxicity.fit(row, column, x[row, column], y, d, grades, sparse, steps=3000)
    scale = 1 / np.sqrt(np.maximum((x**2).mean(0), toxicity.COMMON))
    share = np.array([np.log(((y < k).sum() + 1) / ((y >= k).sum() + 1)) for k in range(1, grades)]) + toxicity.GAP * np.arange(grades - 1)

    def plain(u, b):
        s = (x * scale) @ u
        return -np.mean([np.log(grade_probability(a, b, k)) for a, k in zip(s, y, strict=True)]) + toxicity.HELD / 2 * ((b - share) ** 2).sum()

    u, h = w / scale, 1e-5
    slope_w = np.array([(plain(u + h * e, cuts) - plain(u - h * e, cuts)) / (2 * h) for e in np.eye(d)])
    slope_b = np.array([(plain(u, cuts + h * e) - plain(u, cuts - h * e)) / (2 * h) for e in np.eye(grades - 1)])
    assert np.abs(slope_b).max() < 1e-4 and (np.diff(cuts) > 0).all()
    assert (np.abs(slope_w[u != 0] + sparse * np.sign(u[u != 0])) < 1e-4).all() and (np.abs(slope_w[u == 0]) <= sparse + 1e-4).all()
    assert 0 < (u != 0).sum() < d


def test_severity_by_hand(spark):
    model = toxicity.OrdinalModel({"bad": 1.0, "baddest": 0.5, "badde*": 0.25}, [0.5, 2.0])
    s = 1.0 * (1 + np.log(2)) + 0.5 + 0.25
    above = [1 / (1 + np.exp(c - s)) for c in model.cuts]
    rows = [(1, "Bad, BAD baddest good"), (2, None), (3, ""), (3, "")]
    got = sorted(map(tuple, toxicity.score_toxicity(edge(spark, rows), model).collect()))
    assert np.allclose(got[0][:3], (1, sum(above), above[0])) and got[0][3:] == (sum(p >= 0.5 for p in above), 1)
    none = sum(1 / (1 + np.exp(c)) for c in model.cuts)
    assert np.allclose([r[1] for r in got[1:]], none) and len(got) == 4
    assert sorted(r.doc_id for r in toxicity.drop_toxic(edge(spark, rows), model).collect()) == [2, 3, 3]


def test_toxicity_of_odd_samples(spark):
    for rows in ([], [("a b", 0), ("c", 0)], [("!!", 1), ("?", 0), ("", 1), (None, 0)], [(None, 1), (None, 2)], [("a", None), ("b", 7), ("c", -1)]):
        model = fitted(spark, rows) if rows else toxicity.fit_toxicity(edge(spark, []), spark.createDataFrame([], "doc_id long, grade int"))
        assert model.weights == {} and model.above(toxicity.words("x"))[0] < 0.5, rows
    # Null ids and grades are left out, of several the smallest counts, labels of other documents play no part.
    docs = spark.createDataFrame([(k, "fine words" if k % 2 else "vile words") for k in range(60)] + [(1, "fine words"), (None, "vile")], "doc_id long, text string")
    labels = [(k, int(k % 2 == 0), 1) for k in range(60)] + [(0, None, 1), (3, 1, 0), (None, 1, 1), (999, 1, 1), (4, 1, None)]
    model = toxicity.fit_toxicity(docs, toxicity.grades_of(spark.createDataFrame(labels, "doc_id long, toxic int, quality int")))
    assert model.above(toxicity.words("vile words"))[0] > 0.5 > model.above(toxicity.words("fine words"))[0]
    grades = {tuple(r) for r in toxicity.grades_of(spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, 0), (5, 1, None)], "doc_id long, toxic int, quality int")).collect()}
    assert grades == {(1, 2), (2, 1), (3, 0), (4, None), (5, 1)}


def test_ranking_equals_plain_descent():
    """Newton steps against small gradient steps on the same pairs."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] + draw.normal(size=300) > 0).astype(int)
    model = quality.fit(x, y, n_pairs=500, n_knots=3, decay=1e-2)
    f, again = model.expand(x), np.random.default_rng(7)
    d = f[again.choice(np.flatnonzero(y == 1), 500)] - f[again.choice(np.flatnonzero(y == 0), 500)]
    w = np.zeros(d.shape[1])
    for _ in range(20_000):
        w += 0.5 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 1e-2 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
    assert model.threshold == np.quantile(f @ model.weights, (y == 0).mean())
    assert ((model.scores(x) >= quality.CUT) == (f @ model.weights >= model.threshold - 1e-9)).all()


def test_quality_of_odd_samples(spark):
    docs = edge(spark)
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (2, 1)], [(1, 0), (1, 1), (7, 1), (7, 1), (99, 0), (3, 0)]):
        model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.score_quality(docs, model).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert {r.doc_id: r.held_out for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in EDGE}


def test_quality_on_held_out_rows():
    train, held = labelled("sf0.1", "quality")
    model = quality.fit(np.array([quality.statistics(t) for t, _ in train]), np.array([y for _, y in train]))
    s, y = model.scores(np.array([quality.statistics(t) for t, _ in held])), np.array([y for _, y in held])
    auc = np.mean(s[y == 1][:, None] > s[y == 0][None, :])
    assert auc > 0.97 and np.mean((s >= 0.3) == y) > 0.95


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    table = "embeddings" if "vector_codes" in name else "documents"
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() == n if "packing" not in name else df.count() >= n


def test_native_plan(docs):
    plan = fingerprints.fingerprint_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_many_words_are_merged_at_once():
    """As one by one: words of any length, repeated symbols, symbols that no merge has."""
    draw = random.Random(4)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder = bpe.SpeculativeBPE(public_tokenizers.path(name))
        words = ["".join(draw.choice(kind) for _ in range(draw.randint(1, 40))) for kind in ("etaoinshrdlu", "aab", coder.alphabet, "€0a") for _ in range(400)]
        assert coder.exact_many(words) == [coder.exact(w) for w in words]
    assert coder.exact_many([]) == []

"""The reference grammar on authored sentences, its speed, and the query against texts with planted references."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexlake.operators.citations import references, with_references
from lexlake.operators.prose import links, prose_references, urn_reference

CC, PC, PP, CDS = "codice-civile", "codice-procedura-civile", "dpr-447-1988", "dlgs-285-1992"
REFS = [
    # codes by abbreviation and name
    ("si veda l'art. 1218 c.c.", [(CC, "1218", None)]),
    ("ART. 640 C.P.", [("codice-penale", "640", None)]),
    ("ricorso ex art. 669 c. p. c. urgente", [(PC, "669", None)]),
    ("art. 391 c.p.p. e seguenti", [(PP, "391", None)]),
    ("multa per l'art. 7 cds", [(CDS, "7", None)]),
    ("art. 9 c.d.s.", [(CDS, "9", None)]),
    ("l'art. 1175 cod. civ. impone buona fede", [(CC, "1175", None)]),
    ("art. 12 cod. proc. pen.", [(PP, "12", None)]),
    ("articolo 416 ter del codice penale", [("codice-penale", "416-ter", None)]),
    ("articolo 416-ter del Codice Penale", [("codice-penale", "416-ter", None)]),
    ("art. 3 del codice della proprieta' industriale", [("codice-proprieta-industriale", "3", None)]),
    ("art. 3 del codice della proprietà industriale", [("codice-proprieta-industriale", "3", None)]),
    ("art. 71 del codice dell’amministrazione digitale", [("codice-amministrazione-digitale", "71", None)]),
    ("il nuovo codice della strada prevede sanzioni", [(CDS, None, None)]),
    ("il codice penale militare di guerra resta", [("codice-penale-militare-guerra", None, None)]),
    ("nel cod. pen. manca una regola", [("codice-penale", None, None)]),
    # everyday words that look like codes
    ("versato sul c.c. della ditta", []),
    ("lo dice il CdS in sede plenaria", []),
    ("casella c.p. 77 di Torino", []),
    ("art. 40 del c.c.n.l. commercio", [(None, "40", None)]),
    ("art. 1382 del codice civile francese", [(None, "1382", None)]),
    ("la s.r.l. 12/2019 ha chiuso", []),
    # numbered acts
    ("D.Lgs. n. 36 del 2023", [("dlgs-36-2023", None, None)]),
    ("D. lgs. 231/2001, art. 5", [("dlgs-231-2001", "5", None)]),
    ("dlgs 231/2001", [("dlgs-231-2001", None, None)]),
    ("art. 6 del decreto legislativo 231 / 2001", [("dlgs-231-2001", "6", None)]),
    ("il d.l. 34/2020 e il DL 18/2020", [("dl-34-2020", None, None), ("dl-18-2020", None, None)]),
    ("decreto-legge n. 34 del 2020", [("dl-34-2020", None, None)]),
    ("l. 300/1970 art. 18", [("legge-300-1970", "18", None)]),
    ("la legge, numero 300 del 1970", [("legge-300-1970", None, None)]),
    ("art. 36 bis del d.P.R. n. 600 del 1973", [("dpr-600-1973", "36-bis", None)]),
    ("decreto del Presidente della Repubblica 380/2001", [("dpr-380-2001", None, None)]),
    ("d.p.c.m. 5/2013", [("dpcm-5-2013", None, None)]),
    ("art. 2 del regio decreto 267/1942", [("rd-267-1942", "2", None)]),
    ("tra gli anni 80/2000 nulla", []),
    ("la legge del 2008", []),
    ("legge 12345/2008", []),
    # paragraphs
    ("art. 3, comma 4, della l. 241/1990", [("legge-241-1990", "3", "4")]),
    ("art. 3 co. 4 l. 241/1990", [("legge-241-1990", "3", "4")]),
    ("art. 3, c. 4, della legge 241/1990", [("legge-241-1990", "3", "4")]),
    ("art. 2055 c. 3 c.c.", [(CC, "2055", "3")]),
    ("art. 7, comma 1 ter, del codice della strada", [(CDS, "7", "1-ter")]),
    ("art. 2055 c.c., comma 3", [(CC, "2055", "3")]),
    ("art. 4, commi 5 e 6, c.c.", [(CC, "4", "5")]),
    ("art. 2103, terzo comma, c.c.", [(CC, "2103", "3")]),
    ("al comma 9 soltanto", []),
    # lists
    ("artt. 1218 e 1223 c.c.", [(CC, "1218", None), (CC, "1223", None)]),
    ("artt. 624, 625 ed 626 c.p.", [("codice-penale", x, None) for x in ("624", "625", "626")]),
    ("articoli 2; 3 del codice del consumo", [("codice-consumo", "2", None), ("codice-consumo", "3", None)]),
    ("art. 30 e 31 del d.lgs. 50/2016", [("dlgs-50-2016", "30", None), ("dlgs-50-2016", "31", None)]),
    ("art. 4, 5 e 6 della legge 300/1970", [("legge-300-1970", x, None) for x in "456"]),
    ("l'art. 12 e 9 settimane fa", [(None, "12", None)]),
    ("l'art. 12, 300 euro subito", [(None, "12", None)]),
    ("art. 12, 13-bis allegati", [(None, "12", None), (None, "13-bis", None)]),
    ("artt. 7 e 8, comma 1, c.c.", [(CC, "7", None), (CC, "8", None)]),
    # binding
    ("che dice l'articolo 21?", [(None, "21", None)]),
    ("l'art. 4 basta; si legga poi il d.lgs. 42/2004", [(None, "4", None), ("dlgs-42-2004", None, None)]),
    ("art. 1 del d.lgs. 42/2004 e art. 2 del d.lgs. 36/2023", [("dlgs-42-2004", "1", None), ("dlgs-36-2023", "2", None)]),
    ("c.p.c., all'art. 83", [(PC, "83", None)]),
    ("art. 5 dello statuto sociale", [(None, "5", None)]),
    ("legge 68/1999 e d.lgs. 276/2003", [("legge-68-1999", None, None), ("dlgs-276-2003", None, None)]),
    ("art. 9 c.c. poi ancora art. 9 c.c.", [(CC, "9", None)]),
    # the constitution isn't held
    ("l'art. 21 Cost. e la stampa", []),
    ("articolo 3 della Costituzione", []),
    # nothing
    ("un articolo del giornale", []),
    ("   ", []),
    ("", []),
    (None, []),
]
NIR = "http://www.example.org/uri?urn:nir:stato:"
PROSE = [
    ("ai sensi dell'articolo 4 della legge 20 maggio 1970, n. 300", [("legge-300-1970", "4", None)]),
    ("dal d.lgs. 10 settembre 2003, n. 276, in vigore", [("dlgs-276-2003", None, None)]),
    ("la legge 1° aprile 1981, n. 121", [("legge-121-1981", None, None)]),
    ("con decreto del Presidente della Repubblica 6 giugno 2001, n. 380", [("dpr-380-2001", None, None)]),
    ("il decreto-legge 19 maggio 2020, n. 34, convertito dalla legge 17 luglio 2020, n. 77", [("dl-34-2020", None, None), ("legge-77-2020", None, None)]),
    ("riunione del 3 marzo 2011 rinviata", []),
    ("i soggetti di cui al comma 7", [(None, None, "7")]),
    ("di cui al comma 7, dell'articolo 2", [(None, "2", None)]),
    ("articolo 8 della predetta legge 300/1970", [("legge-300-1970", "8", None)]),
    (f"secondo l'[articolo 3, comma 2]({NIR}legge:1970-05-20;300~art3bis-com2ter) citato", [("legge-300-1970", "3-bis", "2-ter")]),
    (f"articolo 8 della citata [legge n. 300 del 1970]({NIR}legge:1970;300)", [("legge-300-1970", "8", None)]),
    (f"[art. 12 del Codice civile]({NIR}codice.civile:1942-03-16;262~art12)", [(CC, "12", None)]),
    (f"[articolo 3 della Costituzione]({NIR}costituzione:1947-12-27~art3)", []),
    (f"l'[articolo 44 di quel codice]({NIR}codice.inesistente:2001;5~art44)", [(None, "44", None)]),
    ("vedi [la nota](http://www.example.org/x) e l'art. 2 c.c.", [(CC, "2", None)]),
    ("\n ", []),
    (None, []),
]


def short(rows):
    return [(r["act_ref"], r["article"], r["comma"]) for r in rows]


@pytest.mark.parametrize("text,want", REFS)
def test_references(text, want):
    assert short(references(text)) == want


@pytest.mark.parametrize("text,want", PROSE)
def test_prose(text, want):
    assert short(prose_references(text)) == want


def test_numbered_acts_are_described():
    (row,) = references("art. 5 del d.lgs. 42/2004")
    assert (row["act_type"], row["number"], row["year"]) == ("decreto_legislativo", "42", 2004)
    (row,) = references("art. 5 c.c.")
    assert (row["act_type"], row["number"], row["year"]) == ("codice", None, None)


def test_links():
    assert [x[2:] for x in links("a [b](c) [d]( e) [f](g(h) [i\nj](k) [[l](m)] [](n)")] == [("b", "c"), ("l", "m"), ("", "n")]
    assert urn_reference("http://x") is None and urn_reference(f"{NIR}legge:1990;241!vig=2010")["act_ref"] == "legge-241-1990"


@pytest.mark.parametrize("piece", ["art. 5 c.c. ", "art. 5, ", "e 5 ", "artt. 1, 2 ", "legge ", "d.lgs. 1/2001 art. ", "[a](", "](", "[", "comma 1 "])
def test_time_is_linear(piece):
    """Much of one piece takes some ten times as long as a tenth of it, not a hundred times."""

    def took(n):
        text = piece * (n // len(piece))
        began = time.process_time()
        prose_references(text)
        return time.process_time() - began

    took(1000)
    assert took(300_000) < 0.5 + 30 * took(30_000)


def test_planted_references_are_found(spark):
    """Texts of other words with references put between, by brute force: each one alone, in order, once."""
    draw = random.Random(4)
    cases = [(t, w) for t, w in REFS if w and w[0][0]]
    rows = []
    for k in range(40):
        some = draw.sample(cases, 3)
        rows.append((k, " . ".join(f"lorem ipsum {t} dolor" for t, _ in some), [r for _, w in some for r in w]))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, None)], "id long, text string")
    got = {r.id: [(x.act_ref, x.article, x.comma) for x in r.refs] for r in with_references(df, "text").select("id", "refs", F.lit(1).alias("refs_")).collect()}
    for k, _, want in rows:
        assert got[k] == list(dict.fromkeys(want))
    assert got[None] == []

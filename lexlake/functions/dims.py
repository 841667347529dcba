"""Dimension tables of the legal domain."""

from __future__ import annotations

#: Latin ordinal suffixes of article and paragraph numbers, in their legal order.
SUFFIXES = [
    "bis", "ter", "quater", "quinquies", "sexies", "septies", "octies", "novies", "decies", "undecies", "duodecies", "terdecies", "quaterdecies", "quindecies",
    "quinquiesdecies", "sexiesdecies", "septiesdecies", "duodevicies", "octiesdecies", "noviesdecies", "vicies",
]
#: Longest first, so that a suffix is never read as one that it starts with.
SUFFIX_PATTERN = "|".join(sorted(SUFFIXES, key=len, reverse=True))

#: Months.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]

#: Types of acts by the words that name their kind.
TYPE_OF_KIND = {
    "legge": "legge",
    "legge costituzionale": "legge_costituzionale",
    "decreto legge": "decreto_legge",
    "decreto legislativo": "decreto_legislativo",
    "decreto legislativo luogotenenziale": "decreto_legislativo_luogotenenziale",
    "decreto legge luogotenenziale": "decreto_legge_luogotenenziale",
    "decreto luogotenenziale": "decreto_luogotenenziale",
    "decreto legislativo del capo provvisorio dello stato": "decreto_legislativo_cps",
    "regio decreto": "regio_decreto",
    "regio decreto legge": "regio_decreto_legge",
    "regio decreto legislativo": "regio_decreto_legislativo",
    "decreto del presidente della repubblica": "dpr",
    "dpr": "dpr",
    "decreto del presidente del consiglio dei ministri": "dpcm",
    "dpcm": "dpcm",
    "decreto ministeriale": "decreto_ministeriale",
    "dm": "decreto_ministeriale",
    "decreto": "decreto",
    "codice": "codice",
}
#: Prefix of an act's key by its type.
KEY_PREFIX = {
    "legge": "legge",
    "legge_costituzionale": "legge-cost",
    "decreto_legge": "dl",
    "decreto_legislativo": "dlgs",
    "decreto_legislativo_luogotenenziale": "dlgs-lgt",
    "decreto_legge_luogotenenziale": "dl-lgt",
    "decreto_luogotenenziale": "dlt",
    "decreto_legislativo_cps": "dlcps",
    "regio_decreto": "rd",
    "regio_decreto_legge": "rdl",
    "regio_decreto_legislativo": "rdlgs",
    "dpr": "dpr",
    "dpcm": "dpcm",
    "decreto_ministeriale": "dm",
    "decreto": "decreto",
    "codice": "codice",
    "testo_unico": "tu",
    "atto_normativo": "atto",
}
#: How a type is written.
TYPE_LABEL = {
    "legge": "Legge",
    "legge_costituzionale": "Legge Costituzionale",
    "decreto_legge": "Decreto-Legge",
    "decreto_legislativo": "Decreto Legislativo",
    "decreto_legislativo_luogotenenziale": "Decreto Legislativo Luogotenenziale",
    "decreto_legge_luogotenenziale": "Decreto-Legge Luogotenenziale",
    "decreto_luogotenenziale": "Decreto Luogotenenziale",
    "decreto_legislativo_cps": "Decreto Legislativo del Capo Provvisorio dello Stato",
    "regio_decreto": "Regio Decreto",
    "regio_decreto_legge": "Regio Decreto-Legge",
    "regio_decreto_legislativo": "Regio Decreto Legislativo",
    "dpr": "D.P.R.",
    "dpcm": "D.P.C.M.",
    "decreto_ministeriale": "Decreto Ministeriale",
    "decreto": "Decreto",
    "codice": "Codice",
    "testo_unico": "Testo Unico",
    "atto_normativo": "Atto normativo",
}

#: Names that open a code's title, and its key.
CODES = [
    ("codice di procedura civile", "codice-procedura-civile"),
    ("codice di procedura penale", "codice-procedura-penale"),
    ("codice procedura civile", "codice-procedura-civile"),
    ("codice procedura penale", "codice-procedura-penale"),
    ("codice civile", "codice-civile"),
    ("codice penale", "codice-penale"),
    ("codice penale militare di pace", "codice-penale-militare-pace"),
    ("codice penale militare di guerra", "codice-penale-militare-guerra"),
    ("codice della navigazione", "codice-navigazione"),
    ("codice della strada", "codice-strada"),
    ("codice del consumo", "codice-consumo"),
    ("codice dei contratti pubblici", "codice-contratti-pubblici"),
    ("codice della protezione civile", "codice-protezione-civile"),
    ("codice protezione civile", "codice-protezione-civile"),
    ("codice dell ordinamento militare", "codice-ordinamento-militare"),
    ("codice in materia di protezione dei dati personali", "codice-privacy"),
    ("codice delle comunicazioni elettroniche", "codice-comunicazioni-elettroniche"),
    ("codice della proprieta industriale", "codice-proprieta-industriale"),
    ("codice dell amministrazione digitale", "codice-amministrazione-digitale"),
    ("codice del terzo settore", "codice-terzo-settore"),
    ("codice della crisi d impresa", "codice-crisi-impresa"),
    ("codice dei beni culturali", "codice-beni-culturali"),
    ("codice delle assicurazioni private", "codice-assicurazioni-private"),
    ("codice del processo amministrativo", "codice-processo-amministrativo"),
    ("codice antimafia", "codice-antimafia"),
    ("codice della nautica da diporto", "codice-nautica-diporto"),
    ("codice postale e delle telecomunicazioni", "codice-postale-telecomunicazioni"),
]
#: Codes of which several acts had the name over time; the name alone never overrides a header.
SHARED_CODES = ["codice-contratti-pubblici", "codice-procedura-penale", "codice-navigazione", "codice-postale-telecomunicazioni"]
#: Words before a code's name that do not change what it is.
APPROVAL = ["approvazione del ", "testo definitivo del ", "testo del "]

#: The status that a collection's name says; all others are in force.
COLLECTION_STATUS = {"Atti normativi abrogati (in originale)": "abrogato", "DL decaduti": "decaduto"}

#: The type of acts that a collection's name suggests.
COLLECTION_TYPE = {
    "Atti di attuazione Regolamenti UE": "decreto",
    "Atti di recepimento direttive UE": "decreto_legislativo",
    "Atti normativi abrogati (in originale)": "atto_normativo",
    "Codici": "codice",
    "DL decaduti": "decreto_legge",
    "DL e leggi di conversione": "decreto_legge",
    "DL proroghe": "decreto_legge",
    "DPCM": "dpcm",
    "DPR": "dpr",
    "Decreti Legislativi": "decreto_legislativo",
    "Decreti legislativi luogotenenziali": "decreto_legislativo_luogotenenziale",
    "Leggi contenenti deleghe": "legge",
    "Leggi costituzionali": "legge_costituzionale",
    "Leggi delega e relativi provvedimenti delegati": "legge",
    "Leggi di delegazione europea": "legge",
    "Leggi di ratifica": "legge",
    "Leggi finanziarie e di bilancio": "legge",
    "Regi decreti": "regio_decreto",
    "Regi decreti legislativi": "regio_decreto_legislativo",
    "Regolamenti di delegificazione": "dpr",
    "Regolamenti governativi": "dpr",
    "Regolamenti ministeriali": "decreto_ministeriale",
    "Testi Unici": "testo_unico",
}
#: Words that open a partition's heading.
PARTITIONS = ["LIBRO", "PARTE", "TITOLO", "CAPO", "SEZIONE"]

"""Italian words as index terms: stop words, and stems by the published Snowball rules for Italian."""

from __future__ import annotations

import re
from functools import lru_cache

# Stop words, built from what they are made of.
_FUTURE, _CONDITIONAL, _IMPERFECT = ("ò", "ai", "à", "emo", "ete", "anno"), ("ei", "esti", "ebbe", "emmo", "este", "ebbero"), ("o", "i", "a", "amo", "ate", "ano")
_PAST_SUBJUNCTIVE = ("ssi", "sse", "ssimo", "ssero")
#: Prepositions as they join the articles, and the articles' forms after them.
_JOINED, _FORMS = ("a", "da", "de", "ne", "su"), ("l", "llo", "i", "gli", "ll", "gl", "lla", "lle")
#: The remaining stop words.
_WORDS = """ad con col coi da di in su per tra contro io tu lui lei noi voi loro mi ti ci vi lo la li le gli ne il un uno una ma ed se perché anche come dov dove che chi cui non più quale
quanto quanti quanta quante si tutto tutti a c e i l o ho hai ha abbiamo avete hanno abbia abbiate abbiano ebbi avesti ebbe avemmo aveste ebbero avendo avuto avuta avuti avute sono sei è siamo siete
sia siate siano ero eri era eravamo eravate erano fui fosti fu fummo foste furono essendo faccio fai facciamo fanno faccia facciate facciano feci facesti fece facemmo faceste fecero facendo
sto stai sta stiamo stanno stia stiate stiano stetti stesti stette stemmo steste stettero stando"""


def stop_words() -> frozenset[str]:
    """Function words, joined prepositions, possessives, and forms of avere, essere, fare and stare."""
    verbs = [stem + end for stem in ("avr", "sar", "far", "star") for end in _FUTURE + _CONDITIONAL] + [stem + end for stem in ("avev", "facev", "stav") for end in _IMPERFECT]
    verbs += [stem + end for stem in ("ave", "fo", "face", "ste") for end in _PAST_SUBJUNCTIVE]
    own = [stem + end for stem in ("mi", "tu", "su") for end in ("o", "a", "oi" if stem != "mi" else "ei", "e")] + [f"{x}ostr{end}" for x in "nv" for end in "oaie"]
    these = [f"que{x}{end}" for x in ("ll", "st") for end in "oaie"]
    return frozenset([*_WORDS.split(), *verbs, *own, *these, *(p + f for p in _JOINED for f in _FORMS)])


#: Suffixes of the published rules.
_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_AFTER_GERUND, _AFTER_INFINITIVE = ("ando", "endo"), ("ar", "er", "ir")
_DELETE = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_WITH_IC, _LOGIA, _UZIONE, _ENZA = "azione azioni atore atori".split(), "logia logie".split(), "uzione uzioni usione usioni".split(), "enza enze".split()
_AMENT, _AMENTE, _ITA, _IVO = "amento amenti imento imenti".split(), ["amente"], ["ità"], "ivo ivi iva ive".split()
_VERBS = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete
erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano
ivate ivi ivo ono uta ute uti uto ar ir""".split()
_VOWELS = "aeiouàèìòù"
_ACUTE = str.maketrans("áéíóú", "àèìòù")
_OPENS = re.compile(f"[{_VOWELS}][^{_VOWELS}]")


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int, int]:
    """Where the regions of the rules begin: (rv, r1, r2)."""
    vowel = [c in _VOWELS for c in word]
    n, rv = len(word), len(word)
    if n > 2:
        if not vowel[1]:
            rv = next((k + 1 for k in range(2, n) if vowel[k]), n)
        elif vowel[0]:
            rv = next((k + 1 for k in range(2, n) if not vowel[k]), n)
        else:
            rv = 3
    first = _OPENS.search(word)
    r1 = first.end() if first else n
    second = _OPENS.search(word, r1)
    return rv, r1, second.end() if second else n


def _standard(word: str, rv: int, r1: int, r2: int) -> str | None:
    """The word without its standard suffix; null if it has none that may go."""
    end = _longest(word, _DELETE + _WITH_IC + _LOGIA + _UZIONE + _ENZA + _AMENT + _AMENTE + _ITA + _IVO)
    at = len(word) - len(end)
    if not end:
        return None
    cut = lambda w, more: next((w[: -len(m)] for m in more if w.endswith(m) and len(w) - len(m) >= r2), w)
    if end in _AMENT:
        return word[:at] if at >= rv else None
    if end in _AMENTE:
        if at < r1:
            return None
        short = word[:at]
        further = cut(short, ("iv",))
        return cut(further, ("at",)) if further != short else cut(short, ("os", "ic", "abil"))
    if at < r2:
        return None
    if end in _DELETE:
        return word[:at]
    if end in _LOGIA:
        return word[:at] + "log"
    if end in _UZIONE:
        return word[:at] + "u"
    if end in _ENZA:
        return word[:at] + "ente"
    if end in _WITH_IC:
        return cut(word[:at], ("ic",))
    if end in _ITA:
        return cut(word[:at], ("abil", "ic", "iv"))
    short = cut(word[:at], ("at",))
    return cut(short, ("ic",)) if short != word[:at] else short


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; regions are those of the word as it comes, suffixes are taken off from its end."""
    word = word.translate(_ACUTE).replace("qu", "qU")
    for k in range(1, len(word) - 1):
        if word[k] in "ui" and word[k - 1] in _VOWELS and word[k + 1] in _VOWELS:
            word = word[:k] + word[k].upper() + word[k + 1 :]
    rv, r1, r2 = _regions(word)
    pronoun = _longest(word, _PRONOUNS)
    if pronoun:
        base = word[: -len(pronoun)]
        if any(base.endswith(e) and len(base) - len(e) >= rv for e in _AFTER_GERUND):
            word = base
        elif any(base.endswith(e) and len(base) - len(e) >= rv for e in _AFTER_INFINITIVE):
            word = base + "e"
    short = _standard(word, rv, r1, r2)
    if short is None:
        # Verb endings are looked for within the region alone.
        end = _longest(word[rv:], _VERBS)
        short = word[: len(word) - len(end)]
    if short and short[-1] in "aeioàèìò" and len(short) > rv:
        short = short[:-1]
        if short.endswith("i") and len(short) > rv:
            short = short[:-1]
    if short.endswith(("ch", "gh")) and len(short) - 1 >= rv:
        short = short[:-1]
    return short.replace("U", "u").replace("I", "i")


def term(word: str) -> str | None:
    """What an index files a lower-case word under; null for a stop word."""
    return None if word in _STOP else stem(word)


_STOP = stop_words()

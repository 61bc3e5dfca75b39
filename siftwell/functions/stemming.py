"""Stemmers of other languages than English, from the published descriptions of the algorithms.

Each takes a lower-case word and gives its stem. Regions: R1 is what follows the first consonant behind a
vowel, R2 the same within R1. A step looks for the longest of its endings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from siftwell.functions.analysis import stem_english


def _region(word: str, vowels: str, start: int = 0) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings: Iterable[str], start: int = 0) -> str | None:
    """The longest ending that the word has from start on."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)


# --- Porter -------------------------------------------------------------------------------------------------------------


def _measure(stem: str) -> int:
    kinds = re.sub(r"(?<=[aeiou])y|(?<=^)y", "C", stem)
    kinds = re.sub("[aeiouy]+", "V", re.sub("[^aeiouyVC]", "C", kinds).replace("C", "c"))
    return len(re.findall("Vc+", kinds))


def _has_vowel(stem: str) -> bool:
    return bool(re.search(r"[aeiou]|(?<=[^aeiou])y", stem))


def _short_end(stem: str) -> bool:
    return bool(re.search(r"(?:^|[^aeiou])[aeiou][^aeiouwxy]$|[^aeiou]y[^aeiouwxy]$", stem)) and len(stem) > 2


# Endings of the second, third and fourth step and what they become.
_PORTER_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_PORTER_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        end = _longest(word, ("ed", "ing"))
        if end and _has_vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"([^aeiou])\1$", word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_PORTER_2, _PORTER_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, _PORTER_4)
    if end:
        stem = word[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


# --- German ---------------------------------------------------------------------------------------------------------------

_DE = "aeiouyäöü"


def _german(word: str) -> str:
    word = re.sub(f"(?<=[{_DE}])[uy](?=[{_DE}])", lambda m: m[0].upper(), word)
    first = _region(word, _DE)
    r2 = _region(word, _DE, first)
    r1 = max(3, first)
    end = _longest(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(word) - len(end) >= r1 and (end != "s" or word[-2] in "bdfghklmnrt"):
        word = word[: -len(end)]
    end = _longest(word, ("en", "er", "est", "st"))
    if end and len(word) - len(end) >= r1 and (end != "st" or (len(word) >= 6 and word[-3] in "bdfghklmnt")):
        word = word[: -len(end)]
    end = _longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    at = len(word) - len(end) if end else 0
    if end and at >= r2:
        if end in ("end", "ung"):
            word = word[:at]
            if word.endswith("ig") and at - 2 >= r2 and not word.endswith("eig"):
                word = word[:-2]
        elif end in ("ig", "ik", "isch"):
            word = word if word[:at].endswith("e") else word[:at]
        elif end in ("lich", "heit"):
            word = word[:at]
            if word.endswith(("er", "en")) and at - 2 >= r1:
                word = word[:-2]
        else:
            word = word[:at]
            inner = _longest(word, ("lich", "ig"))
            if inner and at - len(inner) >= r2:
                word = word[: -len(inner)]
    return word.lower().translate(str.maketrans("äöü", "aou"))


def german(word: str) -> str:
    return _german(word.replace("ß", "ss"))


def german2(word: str) -> str:
    """With ae, oe and ue read as umlauts, but for ue behind q."""
    return _german(re.sub("qu|ae|oe|ue", lambda m: {"ae": "ä", "oe": "ö", "ue": "ü"}.get(m[0], m[0]), word.replace("ß", "ss")))


# --- Swedish, Norwegian, Danish --------------------------------------------------------------------------------------------

# The endings of the first steps.
_SV_1 = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()
_NO_1 = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
_DA_1 = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()


def swedish(word: str) -> str:
    r1 = max(3, _region(word, "aeiouyäåö"))
    end = _longest(word, [*_SV_1, "s"], r1)
    if end and (end != "s" or word[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        word = word[: -len(end)]
    if _longest(word, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        word = word[:-1]
    end = _longest(word, ("lig", "ig", "els", "löst", "fullt"), r1)
    if end:
        word = word[:-1] if end in ("löst", "fullt") else word[: -len(end)]
    return word


def norwegian(word: str) -> str:
    r1 = max(3, _region(word, "aeiouyæåø"))
    end = _longest(word, [*_NO_1, "s", "erte", "ert"], r1)
    if end in ("erte", "ert"):
        word = word[: -len(end)] + "er"
    elif end == "s":
        if re.search("(?:[bcdfghjlmnoprtvyz]|[^aeiouyæåø]k)s$", word):
            word = word[:-1]
    elif end:
        word = word[: -len(end)]
    if _longest(word, ("dt", "vt"), r1):
        word = word[:-1]
    end = _longest(word, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1)
    return word[: -len(end)] if end else word


def danish(word: str) -> str:
    r1 = max(3, _region(word, "aeiouyæåø"))

    def pair(w: str) -> str:
        return w[:-1] if _longest(w, ("gd", "dt", "gt", "kt"), r1) else w

    end = _longest(word, [*_DA_1, "s"], r1)
    if end and (end != "s" or word[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        word = word[: -len(end)]
    word = pair(word)
    if word.endswith("igst"):
        word = word[:-2]
    end = _longest(word, ("ig", "lig", "elig", "els", "løst"), r1)
    if end:
        word = word[:-1] if end == "løst" else pair(word[: -len(end)])
    if len(word) - 1 >= r1 and re.search(r"([^aeiouyæåø])\1$", word):
        word = word[:-1]
    return word


# --- Dutch --------------------------------------------------------------------------------------------------------------

_NL = "aeiouyè"


def dutch(word: str) -> str:
    word = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    word = re.sub(f"^y|(?<=[{_NL}])y|(?<=[{_NL}])i(?=[{_NL}])", lambda m: m[0].upper(), word)
    first = _region(word, _NL)
    r2 = _region(word, _NL, first)
    r1 = max(3, first)
    cut_e = False

    def single(w: str) -> str:
        return w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def without_en(w: str, end: str) -> str:
        stem = w[: -len(end)]
        good = len(stem) >= r1 and stem and stem[-1] not in _NL and not stem.endswith("gem")
        return single(stem) if good else w

    def without_e(w: str) -> str:
        return single(w[:-1]) if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in tuple(_NL) else w

    end = _longest(word, ("heden", "en", "ene", "s", "se"))
    if end == "heden":
        word = word[:-5] + "heid" if len(word) - 5 >= r1 else word
    elif end in ("en", "ene"):
        word = without_en(word, end)
    elif end:
        stem = word[: -len(end)]
        word = stem if len(stem) >= r1 and stem[-1:] not in tuple(_NL + "j") else word
    shorter = without_e(word)
    cut_e, word = shorter != word, shorter
    if word.endswith("heid") and len(word) - 4 >= r2 and not word.endswith("cheid"):
        word = word[:-4]
        if word.endswith("en"):
            word = without_en(word, "en")
    end = _longest(word, ("end", "ing", "ig", "lijk", "baar", "bar"))
    at = len(word) - len(end) if end else 0
    if end and at >= r2:
        if end in ("end", "ing"):
            word = word[:at]
            if word.endswith("ig") and at - 2 >= r2 and not word.endswith("eig"):
                word = word[:-2]
            else:
                word = single(word)
        elif end == "ig":
            word = word if word[:at].endswith("e") else word[:at]
        elif end == "lijk":
            word = without_e(word[:at])
        elif end == "baar" or cut_e:
            word = word[:at]
    if re.search(f"[^{_NL}](aa|ee|oo|uu)[^{_NL}I]$", word):
        word = word[:-2] + word[-1]
    return word.lower()


# --- Spanish ------------------------------------------------------------------------------------------------------------

_ES = "aeiouáéíóúü"
# Endings of the steps.
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_1 = {
    "": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias".split(),
    "log": "logía logías".split(),
    "u": "ución uciones".split(),
    "ente": "encia encias".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "idad": "idad idades".split(),
    "iva": "iva ivo ivas ivos".split(),
}
_ES_2A = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_2B = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
_ES_2B_GU = "en es éis emos".split()


def _es_rv(w: str) -> int:
    if len(w) < 2:
        return len(w)
    if w[1] not in _ES:
        m = re.compile(f"[{_ES}]").search(w, 2)
        return m.end() if m else len(w)
    if w[0] in _ES:
        m = re.compile(f"[^{_ES}]").search(w, 2)
        return m.end() if m else len(w)
    return min(3, len(w))


def spanish(word: str) -> str:
    plain = str.maketrans("áéíóú", "aeiou")
    r1 = _region(word, _ES)
    r2, rv = _region(word, _ES, r1), _es_rv(word)
    end = _longest(word, _ES_PRONOUNS)
    if end:
        stem = word[: -len(end)]
        verb = _longest(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb and len(stem) - len(verb) >= rv and (verb != "yendo" or stem.endswith("uyendo")):
            word = stem[: -len(verb)] + verb.translate(plain)
    before = word
    end = _longest(word, [e for es in _ES_1.values() for e in es])
    kind = next((k for k, es in _ES_1.items() if end in es), None)
    at = len(word) - len(end) if end else 0
    if end and at >= (r1 if kind == "amente" else r2):

        def less(w: str, *ends: str) -> str:
            inner = _longest(w, ends)
            return w[: -len(inner)] if inner and len(w) - len(inner) >= r2 else w

        stem = word[:at]
        if kind == "ic":
            word = less(stem, "ic")
        elif kind in ("log", "u", "ente"):
            word = stem + kind
        elif kind == "amente":
            word = less(stem, "iv", "os", "ic", "ad")
            if stem.endswith("iv") and word != stem:
                word = less(word, "at")
        elif kind == "mente":
            word = less(stem, "ante", "able", "ible")
        elif kind == "idad":
            word = less(stem, "abil", "ic", "iv")
        elif kind == "iva":
            word = less(stem, "at")
        else:
            word = stem
    if word == before:
        end = _longest(word, _ES_2A, rv)
        if end and word[: -len(end)].endswith("u"):
            word = word[: -len(end)]
        else:
            end = _longest(word, [*_ES_2B, *_ES_2B_GU], rv)
            if end:
                word = word[: -len(end)]
                if end in _ES_2B_GU and word.endswith("gu"):
                    word = word[:-1]
    end = _longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if end:
        word = word[: -len(end)]
        if end in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(plain)


# --- Portuguese -----------------------------------------------------------------------------------------------------------

_PT = "aeiouáéíóúâêô"
# Endings of the steps; ã and õ are a~ and o~ while stemming.
_PT_1 = {
    "": "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split(),
    "log": "logia logias".split(),
    "u": "ução uções uça~o uço~es".split(),
    "ente": "ência ências".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "idade": "idade idades".split(),
    "iva": "iva ivo ivas ivos".split(),
    "ir": "ira iras".split(),
}
_PT_2 = "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras".split()


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _region(word, _PT)
    r2 = _region(word, _PT, r1)
    if len(word) > 2 and word[1] not in _PT:
        m = re.compile(f"[{_PT}]").search(word, 2)
        rv = m.end() if m else len(word)
    elif len(word) > 2 and word[0] in _PT:
        m = re.compile(f"[^{_PT}]").search(word, 2)
        rv = m.end() if m else len(word)
    else:
        rv = min(3, len(word))

    def less(w: str, *ends: str) -> str:
        inner = _longest(w, ends)
        return w[: -len(inner)] if inner and len(w) - len(inner) >= r2 else w

    begun = word
    end = _longest(word, [e for es in _PT_1.values() for e in es])
    kind = next((k for k, es in _PT_1.items() if end in es), None)
    at = len(word) - len(end) if end else 0
    low = {"amente": r1, "ir": rv}.get(kind or "", r2)
    if end and at >= low:
        stem = word[:at]
        if kind in ("log", "u", "ente"):
            word = stem + kind
        elif kind == "amente":
            word = less(stem, "iv", "os", "ic", "ad")
            if stem.endswith("iv") and word != stem:
                word = less(word, "at")
        elif kind == "mente":
            word = less(stem, "ante", "avel", "ível")
        elif kind == "idade":
            word = less(stem, "abil", "ic", "iv")
        elif kind == "iva":
            word = less(stem, "at")
        elif kind == "ir":
            word = stem + "ir" if stem.endswith("e") else word
        else:
            word = stem
    if word == begun:
        end = _longest(word, _PT_2, rv)
        if end:
            word = word[: -len(end)]
    if word != begun:
        if word.endswith("ci") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        end = _longest(word, ("os", "a", "i", "o", "á", "í", "ó"), rv)
        word = word[: -len(end)] if end else word
    end = _longest(word, ("e", "é", "ê"), rv)
    if end:
        word = word[:-1]
        if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


# --- Russian --------------------------------------------------------------------------------------------------------------

_RU = "аеиоуыэюя"
# Endings; those of the first lists need а or я before them.
_RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(f"[{_RU}]", word)
    rv = m.end() if m else len(word)
    r2 = _region(word, _RU, _region(word, _RU))

    def cut(w: str, lists: tuple[list[str], list[str]]) -> str | None:
        """w without the longest ending, which behind а or я may be of the first list."""
        end = _longest(w, [*lists[0], *lists[1]], rv)
        if end is None:
            return None
        if end in lists[0]:
            stem = w[: -len(end)]
            return stem if stem[rv:].endswith(("а", "я")) else None
        return w[: -len(end)]

    found = cut(word, _RU_GERUND)
    if found is not None:
        word = found
    else:
        end = _longest(word, ("ся", "сь"), rv)
        word = word[:-2] if end else word
        end = _longest(word, _RU_ADJECTIVE, rv)
        if end:
            word = word[: -len(end)]
            found = cut(word, _RU_PARTICIPLE)
            word = word if found is None else found
        else:
            found = cut(word, _RU_VERB)
            if found is not None:
                word = found
            else:
                end = _longest(word, _RU_NOUN, rv)
                word = word[: -len(end)] if end else word
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    end = _longest(word, ("ост", "ость"), r2)
    word = word[: -len(end)] if end else word
    end = _longest(word, ("ейш", "ейше"), rv)
    if end:
        word = word[: -len(end)]
    if word.endswith("нн") and len(word) - 2 >= rv:
        word = word[:-1]
    elif not end and word.endswith("ь") and len(word) - 1 >= rv:
        word = word[:-1]
    return word


#: Stemmers by language.
STEMMERS: dict[str, Callable[[str], str]] = {
    "english": stem_english,
    "porter": porter,
    "german": german,
    "german2": german2,
    "swedish": swedish,
    "norwegian": norwegian,
    "danish": danish,
    "dutch": dutch,
    "spanish": spanish,
    "portuguese": portuguese,
    "russian": russian,
}

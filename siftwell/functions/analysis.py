"""Analyzers: text to terms, as Column expressions for documents and as Python for queries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.arrays import before, let
from siftwell.shipping import ship

#: Terms of a field that an index takes unless it is told otherwise; analyzers themselves have no limit.
MAX_FIELD_LENGTH = 10_000
#: Longer runs are parted.
MAX_TOKEN = 255

# The English stop words.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]

#: Token classes of the standard grammar, the more specific first. No run gives back characters (++), as what may follow
#: it isn't of its kind; and letters that nothing of the other classes follows come first, as they are most of a text.
STANDARD = (
    r"((?:[A-Za-z]|(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}])\p{L})\p{L}*+(?![\p{N}._+@&,/'-])"
    r"|[\p{L}\p{N}]++(?:[._+-][\p{L}\p{N}]++)*+@[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)++"  # address
    r"|\p{L}\.(?:\p{L}\.)+"  # acronym
    r"|\p{L}++[&@]\p{L}++"  # company
    r"|[\p{L}\p{N}]++(?:\.[\p{L}\p{N}]++)++"  # host or number with points
    r"|\p{L}*+\p{N}[\p{L}\p{N}]*+(?:[_,/-][\p{L}\p{N}]++)++"  # number with signs
    r"|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"  # a character of its own
    r"|\p{L}++(?:'\p{L}++)++"  # apostrophe
    r"|[\p{L}\p{N}]++)"
)


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _letters(s: str) -> list[str]:
    return [w for w in "".join(c if _is_letter(c) else " " for c in s).split(" ") if w]


@dataclass(frozen=True)
class Analyzer:
    """Terms by name; of a field at most the first most, and of these only those of lengths from least to longest."""

    name: str
    most: int | None = None
    least: int = 0
    longest: int | None = None

    def column(self, text: Column) -> Column:
        """The terms of a text in order; a null text has none."""
        text = F.coalesce(text, F.lit(""))
        if self.name == "keyword":
            terms = F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
        elif self.name == "whitespace":
            terms = F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))
        elif self.name == "letter":
            terms = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
        elif self.name == "standard":
            terms = indexed_terms(text)
        else:
            terms = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
        if self.name == "stop":
            terms = F.filter(terms, lambda t: ~t.isin(STOP_WORDS))
        if self.least or self.longest:
            terms = F.filter(terms, lambda t: (F.length(t) >= self.least) & (F.length(t) <= (self.longest or 1 << 30)))
        return F.slice(terms, 1, self.most) if self.most else terms

    def terms(self, text: str) -> list[str]:
        """The same for a query's text, without the pieces of addresses and with no most."""
        if self.name == "keyword":
            found = [text] if text else []
        elif self.name == "whitespace":
            found = text.split()
        elif self.name == "letter":
            found = _letters(text)
        elif self.name == "standard":
            found = standard_query_terms(text)
        else:
            found = [t for t in _letters(text.lower()) if self.name != "stop" or t not in STOP_WORDS]
        return [t for t in found if self.least <= len(t) <= (self.longest or 1 << 30)]


@dataclass(frozen=True)
class PerField:
    """An analyzer for each field, and one for the others."""

    other: Analyzer
    fields: Mapping[str, Analyzer]

    def of(self, field: str) -> Analyzer:
        return self.fields.get(field, self.other)

    def column(self, field: Column, text: Column) -> Column:
        """The terms of a text by the name of its field in another column."""
        found = self.other.column(text)
        for name, analyzer in self.fields.items():
            found = F.when(field == name, analyzer.column(text)).otherwise(found)
        return found


SIMPLE, STOP, WHITESPACE, LETTER, KEYWORD, STANDARD_ANALYZER = (Analyzer(n) for n in ("simple", "stop", "whitespace", "letter", "keyword", "standard"))


def stop_words(lines: list[str]) -> list[str]:
    """The words of a list, one a line; what follows a bar is a remark."""
    return [w for w in (x.partition("|")[0].strip().lower() for x in lines) if w]


TOKENS = "array<struct<term:string,start:int,end:int,position:int>>"


def tokens(text: Column, pattern: str = r"\p{L}+") -> Column:
    """The runs of a pattern in lower case with their place in the text and among the terms."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    # The text behind the last one has no term.
    pairs = F.zip_with(F.split(text, pattern), found, lambda g, t: F.struct(F.length(g).alias("g"), F.length(t).alias("n"), t.alias("t")))

    def placed(ps: Column) -> Column:
        at = before(F.transform(ps, lambda x: x["g"] + F.coalesce(x["n"], F.lit(0))), lambda a, x: a + x)
        return let(at, lambda starts: F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda x, k: _token(x, starts[k], k)))

    return let(pairs, placed)


def _token(x: Column, at: Column, k: Column) -> Column:
    return F.struct(F.lower(x["t"]).alias("term"), (at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), k.alias("position"))


#: Characters of the pieces that places are read from, a power of two.
PIECE_BITS = 7


def at_places(text: Column, spans: Column) -> Column:
    """What a text has from start to end of each of several spans, in proportion to its length."""
    size = 1 << PIECE_BITS
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))

    def one(ps: Column, x: Column) -> Column:
        k, n = F.shiftright(x["start"], PIECE_BITS), x["end"] - x["start"]
        two = F.concat(F.get(ps, k), F.coalesce(F.get(ps, k + 1), F.lit("")))
        return F.when(n <= size, F.substring(two, x["start"] - k * size + 1, n)).otherwise(F.substring(text, x["start"] + 1, n))

    return let(pieces, lambda ps: F.transform(spans, lambda x: one(ps, x)))


def is_noise(t: Column) -> Column:
    """Terms not worth a place: over 30 letters, or of mixed kinds and long, or changing kind often."""
    n = F.length(t)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{L}+", "a"), r"\p{N}+", "0"), r"[^a0]+", "-")
    digits, letters, signs = t.rlike(r"\p{N}"), t.rlike(r"\p{L}"), t.rlike(r"[^\p{L}\p{N}]")
    return (n > 30) | (F.length(kinds) - 1 >= 4) | (digits & ~letters & (n > 10)) | (digits & letters & signs & (n > 10))


def standard_terms(text: Column) -> Column:
    """Standard grammar, possessives and acronym points removed, lower case, no stop words, no noise."""
    found = F.regexp_extract_all(text, F.lit(STANDARD), F.lit(1))

    def bare(t: Column) -> Column:
        t = F.when(t.rlike(r"^\p{L}\.(\p{L}\.)+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(F.regexp_replace(t, "'[sS]$", ""))
        low = F.lower(t)
        return F.when(low.rlike("^[0-9]+$"), F.regexp_replace(low, "^0+", "")).otherwise(low)

    def kept(t: Column) -> Column:
        # Addresses and hosts aren't noise, and numbers with signs only if long.
        whole = t.contains("@") | t.rlike(_HOST) | t.rlike(_NUMBER) & (F.length(t) <= MAX_NUMBER)
        return ~t.isin(STOP_WORDS) & (t.rlike(_WORD) | whole | ~is_noise(t)) & (t != "")

    # Most are letters only, which need none of these.
    return F.filter(F.transform(found, lambda t: F.when(t.rlike(r"^\p{L}+\z"), F.lower(t)).otherwise(bare(t))), kept)


#: A word that isn't noise; a host; a number with signs, and how long one may be.
_WORD = r"^\p{L}{1,30}\z"
_HOST = r"^[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*(\.[\p{L}\p{N}]+)+$"
_NUMBER, MAX_NUMBER = r"^[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*([._,/-][\p{L}\p{N}]+)+$", 20


def indexed_terms(text: Column) -> Column:
    """The standard terms, and behind them the pieces of addresses and hosts."""

    def whole(terms: Column) -> Column:
        pieces = F.transform(F.filter(terms, lambda t: t.contains("@") | (t.contains(".") & t.rlike(r"\p{L}"))), lambda t: F.filter(address_parts(t), lambda x: (x != t) & (x != "")))
        return F.concat(terms, F.flatten(pieces))

    return let(standard_terms(text), whole)


def standard_query_terms(text: str) -> list[str]:
    """The standard terms of a query's text, by the same patterns."""
    import regex  # its classes are those of the JVM

    out = []
    for m in regex.finditer(STANDARD.replace("IsHan", "Han").replace("IsHiragana", "Hiragana").replace("IsKatakana", "Katakana"), text):
        t = m[0]
        t = t.replace(".", "") if regex.fullmatch(r"\p{L}\.(\p{L}\.)+", t) else regex.sub("'[sS]$", "", t)
        t = t.lower()
        if regex.fullmatch("[0-9]+", t):
            t = t.lstrip("0")
        kinds = regex.sub(r"[^a0]+", "-", regex.sub(r"\p{N}+", "0", regex.sub(r"\p{L}+", "a", t)))
        has = [bool(regex.search(p, t)) for p in (r"\p{N}", r"\p{L}", r"[^\p{L}\p{N}]")]
        noise = len(t) > 30 or len(kinds) - 1 >= 4 or (len(t) > 10 and has[0] and (not has[1] or has[2]))
        whole = "@" in t or regex.search(_HOST, t) or (len(t) <= MAX_NUMBER and regex.search(_NUMBER, t))
        if t and t not in STOP_WORDS and (whole or not noise):
            out.append(t)
    return out


def address_parts(t: Column) -> Column:
    """An address with its user part and their pieces but the last, or a host with its pieces."""
    user = F.split_part(t, F.lit("@"), F.lit(1))
    pieces = F.split(t, "[@._+-]")
    mail = F.array_distinct(F.concat(F.array(t, user), F.slice(pieces, 1, F.size(pieces) - 1)))
    host = F.split(F.regexp_replace(t, r"^www\.", ""), r"\.")
    return F.when(t.contains("@"), mail).when(t.contains("."), F.array_distinct(F.concat(F.array(t), host))).otherwise(F.array(t))


# --- English stemming, from the published description of the Porter2 algorithm -------------------------------------

_VOWEL = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Words with stems of their own, and words that stay.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
    return m.end() if m else len(word)


def _is_short(word: str, r1: int) -> bool:
    end = re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$", word)
    return bool(end) and r1 >= len(word)


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if word in _INVARIANT:
        return word
    word = re.sub(rf"(?:^y|(?<=[{_VOWEL}])y)", "Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub(r"'s'$|'s$|'$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWEL}].", word[:-1]):
        word = word[:-1]
    if word in _INVARIANT:
        return word
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            if end.startswith("eed"):
                if len(word) - len(end) >= r1:
                    word = word[: -len(end)] + "ee"
            elif re.search(f"[{_VOWEL}]", word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or _is_short(word, r1):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                if end == "ogi":
                    word = word[:-1] if word.endswith("logi") else word
                elif end == "li":
                    word = word[:-2] if word[-3:-2] and word[-3] in _LI else word
                else:
                    word = word[: -len(end)] + _STEP2[end]
            break
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if word.endswith(end):
            at = len(word) - len(end)
            if end == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$", word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stemmed_vocabulary(words: DataFrame, column: str, language: str = "english") -> DataFrame:
    """word and stem of the distinct words of a column: the vocabulary is stemmed, not the corpus."""
    from siftwell.functions.stemming import STEMMERS

    ship(words.sparkSession)
    one: Callable[[str], str] = STEMMERS[language]

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return words.select(F.col(column).alias("word")).distinct().select("word", stem("word").alias("stem"))

"""Matching: query trees become one boolean Column over a document's terms, properties, time and URI.

A document is one row, so a whole tree is a filter: scans read only the columns that the tree needs,
nothing is shuffled, and Catalyst may reorder the conjuncts. Documents need: uri, ts, terms (of the text),
property_terms (of the searched text properties, one after another) and properties (an array of structs). A filter
takes the place of terms by what they are worked out from, so what uses them more than once names them by let().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.analysis import Analyzer
from siftwell.functions.arrays import let, let_all
from siftwell.functions.scalar import levenshtein_similarity, wildcard_regex
from siftwell.plans.parts import PROHIBITED, And, DateRange, Fuzzy, MatchAll, MultiPhrase, Or, Part, Prefix, Property, Query, Text, TermRange, Uri, Wildcard

PROPERTY = "struct<type:string,key:string,value:string,searched:boolean,stored:boolean,mutable:boolean,persistent:boolean>"


def prop(kind: str, key: str, value: Column, searched: bool = True, stored: bool = True, mutable: bool = False, persistent: bool = False) -> Column:
    """A property; null and empty values are none (see properties())."""
    fields = {"type": F.lit(kind), "key": F.lit(key), "value": value.cast("string"), "searched": F.lit(searched), "stored": F.lit(stored), "mutable": F.lit(mutable), "persistent": F.lit(persistent)}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def properties(*props: Column) -> Column:
    """An array of properties without those that have no value."""
    return F.filter(F.array(*props), lambda p: p["value"].isNotNull() & (p["value"] != ""))


def analyzed(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """docs with terms and property_terms."""
    texts = F.transform(F.filter("properties", lambda p: (p["type"] == "t") & p["searched"]), lambda p: analyzer.column(p["value"]))
    return docs.withColumns({"terms": analyzer.column(F.col("text")), "property_terms": F.flatten(texts)})


def normal(key: Column, value: Column) -> Column:
    """A keyword's value as it is compared: lower-cased unless its key is private."""
    return F.when(key.startswith("_private:"), value).otherwise(F.lower(value))


def _phrase(terms: Column, words: list[str]) -> Column:
    """If the words stand consecutively."""
    if len(words) == 1:
        return F.array_contains(terms, words[0])

    def there(ts: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains(ts, w) for w in dict.fromkeys(words)])

    return let(terms, lambda ts: F.when(there(ts), F.size(_phrase_places(ts, words)) > 0).otherwise(F.lit(False)))


def phrase_places(terms: Column, words: list[str]) -> Column:
    """Where a phrase begins."""
    return let(terms, lambda ts: _phrase_places(ts, words))


def _phrase_places(terms: Column, words: list[str]) -> Column:
    def here(t: Column, i: Column) -> Column:
        ok = t == words[0]
        for k, w in enumerate(words[1:], 1):
            ok = ok & F.coalesce(F.get(terms, i + k) == w, F.lit(False))
        return F.when(ok, i)

    return F.array_compact(F.transform(terms, here))


def places(terms: Column, word: str) -> Column:
    """Where a term is."""
    return F.array_compact(F.transform(terms, lambda t, i: F.when(t == word, i)))


def sloppy_distance(terms: Column, words: list[str]) -> Column:
    """The least number of moves that brings the words into a phrase, over all their places; null if one is missing.

    A place less the word's number in the phrase is where the phrase would begin; the distance is the width of the
    least window with a beginning of every word. Windows are tried by where they start: each word's next
    beginning from there on, so the work is the number of beginnings times that of words.
    """
    return let(terms, lambda ts: let_all([_shifted(ts, w, n) for n, w in enumerate(words)], _least_width))


def _least_width(lists: list[Column]) -> Column:
    starts = F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))

    def width(low: Column) -> Column:
        # The first of a sorted list from low on; null where a word has none left.
        nexts = [F.array_min(F.filter(x, lambda p: p >= low)) for x in lists]
        missing = nexts[0].isNull()
        for x in nexts[1:]:
            missing = missing | x.isNull()
        last = F.greatest(*nexts) if len(nexts) > 1 else nexts[0]
        return F.when(~missing, last - low)

    return F.array_min(F.transform(starts, width))


def _shifted(terms: Column, word: str, n: int) -> Column:
    return F.transform(places(terms, word), lambda p: p - n)


def multi_phrase_places(terms: Column, words: list[list[str]]) -> Column:
    """Where a phrase begins that has one of several words at each place."""

    def found(ts: Column) -> Column:
        def here(t: Column, i: Column) -> Column:
            ok = t.isin(words[0])
            for k, ws in enumerate(words[1:], 1):
                ok = ok & F.coalesce(F.get(ts, i + k).isin(ws), F.lit(False))
            return F.when(ok, i)

        return F.array_compact(F.transform(ts, here))

    return let(terms, found)


# --- filters of hits, behind a search ----------------------------------------------------------------------------------


def all_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def any_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a | b, filters) if filters else F.lit(False)


def none_of(*filters: Column) -> Column:
    return ~any_of(*filters)


def filtered(hits: DataFrame, test: Column) -> DataFrame:
    """The hits that a filter leaves; a null test drops a hit."""
    return hits.where(F.coalesce(test, F.lit(False)))


def existing(hits: DataFrame, files: DataFrame) -> DataFrame:
    """The hits whose file is still there (files: uri), with their present address where it has another (now_uri)."""
    there = files.select(F.col("uri").alias("__uri"), *([F.col("now_uri").alias("__now")] if "now_uri" in files.columns else [F.lit(None).cast("string").alias("__now")]))
    return hits.join(there, F.col("uri") == F.col("__uri")).withColumn("uri", F.coalesce("__now", "uri")).drop("__uri", "__now")


class Matcher:
    """Compiles parts for documents of one analyzer."""

    def __init__(self, analyzer: Analyzer) -> None:
        self.analyzer = analyzer

    def _keyword(self, test) -> Column:
        return F.exists("properties", lambda p: (p["type"] == "k") & p["searched"] & test(normal(p["key"], p["value"])))

    def _any_term(self, test) -> Column:
        return F.exists("terms", test) | F.exists("property_terms", test) | self._keyword(test)

    def part(self, p: Part) -> Column | None:
        """The predicate of a part; null if it has nothing to ask for and is left out."""
        if isinstance(p, Text):
            words = self.analyzer.terms(p.text)
            asks = []
            if words:
                test = (lambda t: F.coalesce(sloppy_distance(t, words) <= p.slop, F.lit(False))) if p.slop and len(words) > 1 else (lambda t: _phrase(t, words))
                if p.full_text:
                    asks.append(test(F.col("terms")))
                if p.properties:
                    asks.append(test(F.col("property_terms")))
                    whole = p.text.lower()
                    asks.append(self._keyword(lambda v: v == whole))
            return reduce(lambda a, b: a | b, asks) if asks else None
        if isinstance(p, Wildcard):
            pattern = wildcard_regex(p.pattern.lower())
            return self._any_term(lambda t: t.rlike(pattern))
        if isinstance(p, Prefix):
            return self._any_term(lambda t: t.startswith(p.prefix))
        if isinstance(p, Fuzzy):
            near = lambda t: t.startswith(p.term[: p.prefix]) & (levenshtein_similarity(t, p.term, p.prefix) > p.similarity)
            return self._in(p.key, lambda ts: F.exists(ts, near))
        if isinstance(p, TermRange):
            return self._in(p.key, lambda ts: F.exists(ts, lambda t: _between(t, p)))
        if isinstance(p, MultiPhrase):
            return F.size(multi_phrase_places(F.col("terms"), p.words)) > 0
        if isinstance(p, Property):
            return self._property(p)
        if isinstance(p, DateRange):
            return self._dates(p)
        if isinstance(p, Uri):
            return F.col("uri") == p.uri
        if isinstance(p, MatchAll):
            return F.lit(True)
        if isinstance(p, Or):
            asks = [a for a in (self.part(x) for x in p.parts) if a is not None]  # what is prohibited inside counts as asked for
            if not asks:
                return None
            if p.least > 1:
                return reduce(lambda a, b: a + b, [a.cast("int") for a in asks]) >= p.least
            return reduce(lambda a, b: a | b, asks)
        if isinstance(p, And):
            return self.tree(p.parts)
        raise TypeError(f"no such part: {p!r}")

    def _in(self, key: str | None, test) -> Column:
        """A test of the text's terms, or of those of a text property."""
        if key is None:
            return test(F.col("terms"))
        return F.exists("properties", lambda x: (x["type"] == "t") & (x["key"] == key) & test(self.analyzer.column(x["value"])))

    def _property(self, p: Property) -> Column | None:
        of_key = (lambda x: x["searched"]) if p.key == "_all" else (lambda x: x["key"] == p.key)
        if p.kind == "t":
            words = self.analyzer.terms(p.value)
            if not words:
                return None
            if p.slop and len(words) > 1:
                test = lambda t: F.coalesce(sloppy_distance(t, words) <= p.slop, F.lit(False))
            else:
                test = lambda t: _phrase(t, words)
            return F.exists("properties", lambda x: (x["type"] == "t") & of_key(x) & test(self.analyzer.column(x["value"])))
        wanted = p.value if p.key.startswith("_private:") else p.value.lower()
        return F.exists("properties", lambda x: (x["type"] == p.kind) & of_key(x) & (normal(x["key"], x["value"]) == wanted))

    def _dates(self, p: DateRange) -> Column:
        low, high = p.start, p.end
        if low and high and low > high:
            low, high = high, low

        def within(x: Column, after, before) -> Column:
            # An open end has no bound.
            return reduce(lambda a, b: a & b, [x.isNotNull(), *([after(low)] if low else []), *([before(high)] if high else [])])

        ts = F.col("ts")
        stamp = F.coalesce(within(ts, lambda d: ts >= F.lit(d), lambda d: ts <= F.lit(d)), F.lit(False))

        def dates(v: Column) -> Column:
            # As text they compare as times do; years of five digits are after all bounds.
            late, digits = F.length(v) > 14, lambda d: f"{d.year:04d}{d:%m%d%H%M%S}"
            return v.rlike("^[0-9]+$") & within(v, lambda d: late | (v >= digits(d)), lambda d: ~late & (v <= digits(d)))

        of_key = (lambda x: F.lit(True)) if p.key == "_all" else (lambda x: x["key"] == p.key)
        dated = F.exists("properties", lambda x: (x["type"] == "d") & of_key(x) & dates(x["value"]))
        return stamp if p.key == "Timestamp" else stamp | dated if p.key == "_all" else dated

    def tree(self, parts: list[Part]) -> Column:
        """All that is required and nothing that is prohibited; false if nothing is required."""
        required = [a for p in parts if p.logic != PROHIBITED and (a := self.part(p)) is not None]
        barred = [a for p in parts if p.logic == PROHIBITED and (a := self.part(p)) is not None]
        if not required:
            return F.lit(False)
        return reduce(lambda a, b: a & b, [*required, *[~a for a in barred]])

    def search(self, docs: DataFrame, query: Query | Part) -> DataFrame:
        """The documents (analyzed) that match."""
        if isinstance(query, Query):
            if "domain" in docs.columns:
                docs = docs.where(F.col("domain").bitwiseAND(F.lit(query.domain)) != 0)
            return docs.where(self.tree(query.parts))
        return docs.where(self.tree([query]))


def _between(t: Column, p: TermRange) -> Column:
    ok = F.lit(True)
    if p.low is not None:
        ok = ok & ((t >= p.low) if p.inclusive else (t > p.low))
    if p.high is not None:
        ok = ok & ((t <= p.high) if p.inclusive else (t < p.high))
    return ok

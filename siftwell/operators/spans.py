"""Spans: where things are in a document's terms, as arrays of (first, end) per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.arrays import let, let_all
from siftwell.operators.match import places

SPANS = "array<struct<first:int,end:int>>"


def term(terms: Column, word: str) -> Column:
    return F.transform(places(terms, word), lambda p: F.struct(p.alias("first"), (p + 1).alias("end")))


def first(spans: Column, end: int) -> Column:
    """Those that end in the first places."""
    return F.filter(spans, lambda s: s["end"] <= end)


def either(*spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*spans)))


def without(include: Column, exclude: Column) -> Column:
    """Those that overlap none of the others."""
    return let(exclude, lambda xs: F.filter(include, lambda s: ~F.exists(xs, lambda x: (x["first"] < s["end"]) & (s["first"] < x["end"]))))


def near(a: Column, b: Column, slop: int, ordered: bool = True) -> Column:
    """Spans over one of each with at most slop places between them."""

    def pairs(x: Column, y: Column) -> Column:
        # Of each x, the y after it that are close enough.
        return F.flatten(F.transform(x, lambda s: F.transform(F.filter(y, lambda t: (t["first"] >= s["end"]) & (t["first"] - s["end"] <= slop)), lambda t: F.struct(s["first"].alias("first"), t["end"].alias("end")))))

    return let_all([a, b], lambda x: either(pairs(x[0], x[1])) if ordered else either(pairs(x[0], x[1]), pairs(x[1], x[0])))


def near_all(clauses: list[Column], slop: int, ordered: bool = True) -> Column:
    """Spans over one of each of several clauses with at most slop places, in all, between them.

    In order: each span of the first goes on with those of the next behind it, and places between add up.
    In any order: windows that begin with a span, hold one of each and are no wider than their words and slop.
    """
    return let_all(clauses, lambda xs: _near_all(xs, slop, ordered))


def _near_all(clauses: list[Column], slop: int, ordered: bool) -> Column:
    if ordered:
        found = F.transform(clauses[0], lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), F.lit(0).alias("gap")))
        for clause in clauses[1:]:
            found = _further(found, clause, slop)
        return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")))))
    starts = F.array_sort(F.array_distinct(F.transform(F.concat(*clauses), lambda s: s["first"])))

    def window(low):
        nexts = [F.array_min(F.transform(F.filter(c, lambda s: s["first"] >= low), lambda s: F.struct(s["end"].alias("end"), s["first"].alias("first")))) for c in clauses]
        end = F.greatest(*[x["end"] for x in nexts])
        words = nexts[0]["end"] - nexts[0]["first"]
        for x in nexts[1:]:
            words = words + x["end"] - x["first"]
        whole = nexts[0].isNotNull()
        for x in nexts[1:]:
            whole = whole & x.isNotNull()
        return F.when(whole & (F.least(*[x["first"] for x in nexts]) == low) & (end - low - words <= slop), F.struct(low.alias("first"), end.alias("end")))

    return F.array_compact(F.transform(starts, window))


def _further(found: Column, clause: Column, slop: int) -> Column:
    def on(s: Column) -> Column:
        behind = F.filter(clause, lambda t: (t["first"] >= s["end"]) & (s["gap"] + t["first"] - s["end"] <= slop))
        return F.transform(behind, lambda t: F.struct(s["first"].alias("first"), t["end"].alias("end"), (s["gap"] + t["first"] - s["end"]).alias("gap")))

    return F.flatten(F.transform(found, on))


def frequency(spans: Column) -> Column:
    """How often a span query is met: a span counts the less the longer it is."""
    return F.aggregate(spans, F.lit(0.0), lambda a, s: a + 1.0 / (s["end"] - s["first"] + 1))

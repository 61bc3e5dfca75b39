"""Running sums and groups over arrays, in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that one array is made of by adding to it, which copies it each time; and so many of such arrays' sums.
CHUNKS = (64, 256)


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is worked out once; no step over an empty array, as that copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), x, lambda a, _: a, then)


def let_all(xs: list[Column], then: Callable[[list[Column]], Column]) -> Column:
    """The same of several."""
    return let(xs[0], lambda x: let_all(xs[1:], lambda rest: then([x, *rest]))) if xs else then([])


def before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each whole number, what merge (a sum, or the greatest) makes of zero and those before it."""

    def run(part: Column, first: Column) -> Column:
        none = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, none, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def whole(vs: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return run(vs, F.lit(0))
        starts = F.sequence(F.lit(1), F.greatest(F.size(vs), F.lit(1)), F.lit(sizes[0]))

        def merged(chunks: Column) -> Column:
            sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge))
            return F.flatten(F.zip_with(chunks, let(sums, lambda x: whole(x, sizes[1:])), run))

        return let(F.transform(starts, lambda k: F.slice(vs, k, sizes[0])), merged)

    return let(values, lambda vs: whole(vs, CHUNKS))


def groups(values: Column, key: str, fields: list[str]) -> Column:
    """key and fields of an array of structs that is sorted by key: for each of its values, the arrays of the others."""

    def parted(columns: list[Column]) -> Column:
        ks, others = columns[0], columns[1:]
        firsts = F.array_compact(F.transform(ks, lambda x, i: F.when((i == 0) | ~F.get(ks, i - 1).eqNullSafe(x), i)))
        return let(firsts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(ks, a).alias(key), *[F.slice(v, a + 1, F.coalesce(F.get(at, k + 1), F.size(ks)) - a).alias(f) for f, v in zip(fields, others)])))

    return let(values, lambda xs: let_all([xs[f] for f in (key, *fields)], parted))

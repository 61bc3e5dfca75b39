"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each document gives counts, and from them a vector of transformed statistics. For each language and
source, location and scatter come from the SUBSET share of its documents whose scatter has the least
determinant: from three starts (quartiles, squashed deviations, directions) concentration steps keep the
documents of least Mahalanobis distance and estimate anew; of the starts the one of least determinant
goes on until its determinant falls no more. A reweighting step then estimates from all documents within
TRIM. A document farther than CUTOFF from its group's centre is rejected, as is one that fails the base rules.

Small groups lean on their language, and small languages on all documents, as if each group had
PRIOR_ROWS rows more that are like these; there is no size at which a group is treated otherwise.

Vectors are whole thousandths, so that sums are exact and the verdicts don't depend on how rows are
dealt out. Distances are gathered in RINGS rings of a sixteenth of a standard deviation; the subset is
the innermost rings that hold the share. The scatter of a statistic that hardly varies is raised to
its floor (most documents have no symbols at all).

Hostile cases: a null or blank text has no words and fails; a null language or source counts as an
empty one; repeated rows count each; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import GAP, WORD, forget, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = r"[^#*$%&|<>]+"
SPACES = " \t\n\x0b\x0c\r"

SUBSET = 0.75
#: Rows that a group borrows from its language, and a language from all.
PRIOR_ROWS = 50
#: Squared distance beyond which a document is an outlier: 99.999 % of a chi-square of 5 degrees.
CUTOFF = 30.86
#: Squared distance within which documents count for the last estimate: 97.5 % of it.
TRIM = 12.833
#: Make the scatter of the inner 75 %, and of the inner 97.5 %, of a 5-dimensional normal distribution that of the whole.
CONSISTENCY, TRIM_CONSISTENCY = 1.412, 1.0555
RINGS, FINE = 512, 16
#: Steps that every start gets, and the fall of a log-determinant that counts as one.
FIRST_STEPS, FALL = 2, 1e-4
SCALE = 1000
#: The least standard deviation of each statistic, in thousandths.
FLOORS = {"log_words": 300, "word_length": 250, "symbols": 120, "dup_lines": 450, "repeats": 80}
DIMS = tuple(FLOORS)
#: Up to so many groups their estimates (of some 300 bytes each) are broadcast; beyond, they are joined.
BROADCAST_GROUPS = 4096
#: The words that one packed sort key can place.
PLACES = 20
#: How a key and the next stand to each other: of other hashes, of equal windows, of equal hashes but other windows.
APART, EQUAL, CLASH = 0, 1, 2


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The counts of every whole text, with the group of its language and source; carry: and the row itself."""
    row = ["row"] if carry else []
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    df = docs.select(*whole, F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), source.alias("source"), text.alias("t"))
    df = df.withColumn("trimmed", F.btrim("t", F.lit(SPACES)))
    df = df.withColumn("ws", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", GAP)))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda s: s.rlike(WORD)))
    df = df.select(
        *row,
        "doc_id",
        "lang",
        "source",
        "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.regexp_replace("trimmed", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeats(df).drop("ws")


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in windows that occur twice or more.

    A window's hash and place share one long, so that equal windows are neighbours after a primitive
    sort; neighbours are then compared word by word. Where other windows share a hash, and in texts of more
    words than a key can place, whole windows are sorted instead.
    """
    ws, low = F.col("ws"), (1 << PLACES) - 1

    def window(i: Column) -> list[Column]:
        return [F.get(ws, i + k) for k in range(WINDOW)]

    def packed(_: Column, i: Column) -> Column:
        return F.xxhash64(*window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    def beside(x: Column, k: Column) -> Column:
        """How a key and the one after it stand; the last key's is apart, as its neighbour is null."""
        y = F.get("keys", k + 1)
        equal = F.lit(True)
        for a, b in zip(window(place(x)), window(place(y))):
            equal = equal & (a == b)
        return F.when(F.shiftright(x.bitwiseXOR(y), PLACES) == 0, F.when(equal, EQUAL).otherwise(CLASH)).otherwise(APART)

    n = F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))
    full = F.slice(F.transform(ws, packed), 1, n)
    df = df.withColumn("keys", F.sort_array(F.when(F.size(ws) <= low, full).otherwise(F.array().cast("array<bigint>"))))
    df = df.withColumn("beside", F.transform("keys", beside))
    exact = (F.size(ws) > low) | F.array_contains("beside", CLASH)
    wide = F.slice(F.transform(ws, lambda _, i: F.struct(*[w.alias(f"w{k}") for k, w in enumerate(window(i))], i.alias("p"))), 1, n)
    df = df.withColumn("wide", F.when(exact, F.sort_array(wide)))

    def bare(e: Column) -> Column:
        return F.struct(*[e[f"w{k}"] for k in range(WINDOW)])

    def again(k: Column) -> Column:
        return (F.get("beside", k) == EQUAL) | F.coalesce(F.get("beside", k - 1) == EQUAL, F.lit(False))

    places = F.transform(F.filter("keys", lambda x, k: again(k)), place)
    wide_places = F.transform(F.filter("wide", lambda e, k: F.coalesce(bare(e) == bare(F.get("wide", k - 1)), F.lit(False)) | F.coalesce(bare(e) == bare(F.get("wide", k + 1)), F.lit(False))), lambda e: e["p"])
    df = df.withColumn("places", F.sort_array(F.when(F.col("wide").isNull(), places).otherwise(wide_places)))
    covered = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))))
    counted = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", counted).drop("keys", "beside", "wide", "places")


def _vector(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    value = {
        "log_words": F.log1p("n_words"),
        "word_length": F.least(F.col("word_chars") / n, F.lit(20.0)),
        "symbols": F.least(F.sqrt(F.col("n_symbols") / n), F.lit(20.0)),
        "dup_lines": F.log1p("n_dup_lines"),
        "repeats": F.col("n_repeat_words") / n,
    }
    return df.withColumns({k: F.round(v * SCALE).cast("long") for k, v in value.items()})


KEY = ("lang", "source")
_PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
#: The columns of an estimate: mean and the lower triangle of the Cholesky root of the scatter.
_MEANS, _ROOTS = [f"m{i}" for i in range(len(DIMS))], [f"l{i}{j}" for i, j in _PAIRS]
_STARTS = ("quartiles", "squashed", "directions")


def _with(df: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    return df.join(F.broadcast(params) if few else params, list(KEY))


def _rooted(df: DataFrame, entry) -> DataFrame:
    """df with the Cholesky root of the scatter whose entries entry(i, j) gives, and half its log-determinant."""
    det = F.lit(0.0)
    for i, j in _PAIRS:
        # What hardly varies is raised to its floor.
        rest = F.greatest(entry(i, j), F.lit(float(FLOORS[DIMS[i]] ** 2))) if i == j else entry(i, j)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
        det = det + F.log(f"l{i}{j}") if i == j else det
    return df.withColumn("det", det)


def _centres(df: DataFrame) -> DataFrame:
    """The median and a standard deviation from the quartiles of each statistic of each group."""
    step = 50
    cells = df.select(*KEY, F.posexplode(F.array(*[F.floor(F.col(d) / step) for d in DIMS])).alias("dim", "cell")).groupBy(*KEY, "dim", "cell").agg(F.count(F.lit(1)).alias("c"))
    lists = cells.groupBy(*KEY, "dim").agg(F.sort_array(F.collect_list(F.struct("cell", "c"))).alias("cells"))

    def quantile(q: float) -> Column:
        total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, e: a + e["c"])
        none = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at"))
        walk = F.aggregate(
            "cells", none, lambda a, e: F.struct((a["sum"] + e["c"]).alias("sum"), F.when(a["at"].isNull() & (a["sum"] + e["c"] >= total * q), e["cell"]).otherwise(a["at"]).alias("at"))
        )
        return walk["at"] * step + step / 2

    lists = lists.select(*KEY, "dim", quantile(0.5).alias("mid"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("spread"))
    wide = lists.groupBy(*KEY).agg(*[F.max(F.when(F.col("dim") == i, F.struct("mid", "spread"))).alias(f"q{i}") for i in range(len(DIMS))])
    sizes = [F.greatest(F.col(f"q{i}.spread"), F.lit(float(FLOORS[d]))).alias(f"s{i}") for i, d in enumerate(DIMS)]
    return wide.select(*KEY, *[F.col(f"q{i}.mid").cast("double").alias(f"m{i}") for i in range(len(DIMS))], *sizes)


def _starts(df: DataFrame) -> DataFrame:
    """The estimates that each group starts from, three of them: all have its medians and deviations from quartiles; correlations
    are none, those of the deviations squashed by a hyperbolic tangent, and those of the deviations' directions."""
    centres = written(_centres(df), "centres")
    few = centres.count() <= BROADCAST_GROUPS
    z = [(F.col(d) - F.col(f"m{i}")) / F.col(f"s{i}") for i, d in enumerate(DIMS)]
    length = F.lit(0.0)
    for x in z:
        length = length + x * x
    length = F.greatest(F.sqrt(length), F.lit(1e-9))
    values = {"squashed": [F.tanh(x) for x in z], "directions": [x / length for x in z]}
    # Whole thousandths here too.
    whole = [F.round(v * SCALE).cast("long").alias(f"{name}{i}") for name, vs in values.items() for i, v in enumerate(vs)]
    sums = [F.sum(F.col(f"{name}{i}") * F.col(f"{name}{j}")).cast("double").alias(f"{name}{i}{j}") for name in values for i, j in _PAIRS]
    sums = _with(df, centres, few).select(*KEY, *whole).groupBy(*KEY).agg(*sums)
    sums = written(centres.join(F.broadcast(sums) if few else sums, list(KEY)), "starts")
    found = None
    for name in _STARTS:

        def entry(i: int, j: int, name: str = name) -> Column:
            if i == j:
                return F.col(f"s{i}") * F.col(f"s{j}")
            if name == "quartiles":
                return F.lit(0.0)
            both = F.sqrt(F.col(f"{name}{i}{i}") * F.col(f"{name}{j}{j}"))
            # Shrunk a little, so that the matrix stays positive.
            return F.when(both > 0, 0.9 * F.col(f"{name}{i}{j}") / both).otherwise(F.lit(0.0)) * F.col(f"s{i}") * F.col(f"s{j}")

        one = _rooted(sums, entry).select(*KEY, F.lit(name).alias("start"), *_MEANS, *_ROOTS, "det")
        found = one if found is None else found.unionByName(one)
    found = written(found, "mcd")
    forget(centres, sums)
    return found


def _distance(df: DataFrame) -> DataFrame:
    """df with d2, by forward substitution through the Cholesky root."""
    for i, d in enumerate(DIMS):
        y = F.col(d).cast("double") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(len(DIMS)):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return df.withColumn("d2", total)


def _moments() -> list[Column]:
    return [F.count(F.lit(1)), *[F.sum(d) for d in DIMS], *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])) for i, j in _PAIRS]]


def _estimated(sums: DataFrame, consistency: float, few: bool) -> DataFrame:
    """Estimates from sums (the key, start and s: number, sums and sums of products of the rows that count)."""
    width = 1 + len(DIMS) + len(_PAIRS)
    sums = written(sums, "sums")

    def share(s: Column) -> Column:
        return F.transform(s, lambda x: x / F.greatest(s[0], F.lit(1.0)))

    def added(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy("start", *by).agg(F.array(*[F.sum(F.col("s")[k].cast("decimal(38,0)")).cast("double") for k in range(width)]).alias("s"))

    def leaning(s: Column, on: Column) -> Column:
        """The mean moments of s with those of on as PRIOR_ROWS rows more."""
        return F.zip_with(s, on, lambda x, y: (x + PRIOR_ROWS * y) / (s[0] + PRIOR_ROWS))

    langs = added(sums, "lang")
    # One row for each start.
    langs = langs.join(F.broadcast(added(langs).select("start", share(F.col("s")).alias("all"))), "start")
    langs = langs.select("start", "lang", leaning(F.col("s"), F.col("all")).alias("of_lang"))
    keys = sums.join(F.broadcast(langs) if few else langs, ["start", "lang"]).select("start", *KEY, leaning(F.col("s"), F.col("of_lang")).alias("v"))
    keys = keys.select("start", *KEY, "v", *[F.col("v")[1 + i].alias(m) for i, m in enumerate(_MEANS)])

    def entry(i: int, j: int) -> Column:
        return (F.col("v")[1 + len(DIMS) + _PAIRS.index((i, j))] - F.col(f"m{i}") * F.col(f"m{j}")) * consistency

    out = written(_rooted(keys, entry).select(*KEY, "start", *_MEANS, *_ROOTS, "det"), "mcd")
    forget(sums)
    return out


def _concentrate(df: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """New estimates of each group and start from its innermost rings."""
    ring = F.least(F.floor(F.sqrt("d2") * FINE), F.lit(RINGS - 1))
    rings = _distance(_with(df, params, few)).withColumn("ring", ring)
    rings = rings.groupBy("start", *KEY, "ring").agg(*[s.alias(f"s{k}") for k, s in enumerate(_moments())])
    width = 1 + len(DIMS) + len(_PAIRS)
    rings = rings.select("start", *KEY, F.struct("ring", F.array(*[f"s{k}" for k in range(width)]).alias("s")).alias("e"))
    keys = rings.groupBy("start", *KEY).agg(F.sort_array(F.collect_list("e")).alias("es"))
    whole = F.aggregate("es", F.lit(0).cast("long"), lambda a, e: a + e["s"][0])
    keys = keys.withColumn("least", F.ceil(whole * SUBSET))
    zeros = F.array_repeat(F.lit(0).cast("long"), width)
    inner = F.aggregate("es", zeros, lambda a, e: F.when(a[0] >= F.col("least"), a).otherwise(F.zip_with(a, e["s"], lambda x, y: x + y)))
    return _estimated(keys.select("start", *KEY, inner.alias("s")), CONSISTENCY, few)


def _reweighted(df: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """The last estimates, from all documents within TRIM; a group without any leans on its language alone."""
    near = F.when(F.col("d2") <= TRIM, 1).otherwise(0)
    sums = [F.sum(near), *[F.sum(F.col(d) * near) for d in DIMS], *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j]) * near) for i, j in _PAIRS]]
    sums = _distance(_with(df, params, few)).groupBy("start", *KEY).agg(F.array(*sums).alias("s"))
    return _estimated(sums, TRIM_CONSISTENCY, few)


def estimates(eligible: DataFrame) -> DataFrame:
    """The written estimates of each group of eligible (lang, source and the vector)."""
    now = _starts(eligible)
    few = now.count() <= BROADCAST_GROUPS * len(_STARTS)
    for _ in range(FIRST_STEPS):
        nxt = _concentrate(eligible, now, few)
        forget(now)
        now = nxt
    best = written(now.groupBy(*KEY).agg(F.min_by(F.struct("start", *_MEANS, *_ROOTS, "det"), F.struct("det", "start")).alias("x")).select(*KEY, "x.*"), "mcd")
    forget(now)
    now = best.withColumn("start", F.lit("best"))
    while True:
        nxt = _concentrate(eligible, now, few)
        both = nxt.join(best.select(*KEY, F.struct(*_MEANS, *_ROOTS, "det").alias("was")), list(KEY))
        falls = F.col("det") < F.col("was.det") - FALL
        kept = F.when(falls, F.struct(*_MEANS, *_ROOTS, "det")).otherwise(F.col("was"))
        better = written(both.select(*KEY, falls.alias("moved"), kept.alias("x")).select(*KEY, "moved", "x.*"), "mcd")
        moved = better.where("moved").limit(1).count()
        forget(nxt, best)
        best = better
        now = best.drop("moved").withColumn("start", F.lit("best"))
        if not moved:
            last = _reweighted(eligible, now, few)
            forget(best)
            return last


def _ruled(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return _vector(stats).withColumn("base_failed", failed)


def _judged(stats: DataFrame) -> DataFrame:
    """The rows of ruled, written statistics that pass the base rules, with d2 and kept."""
    passed = stats.where(~F.col("base_failed"))
    params = estimates(passed.select(*KEY, *DIMS))
    found = _distance(_with(passed, params.drop("start"), params.count() <= BROADCAST_GROUPS))
    return found.withColumn("kept", F.col("d2") <= CUTOFF)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 (null where the base rules fail) and kept of each row."""
    stats = written(_ruled(statistics(docs)), "quality")
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = _judged(stats).select(*counts, F.col("d2").alias("distance2"), "kept")
    return judged.unionByName(stats.where("base_failed").select(*counts, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept")))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are. They are written beside their counts, as counting twice costs more than
    writing; the estimates read the counts only."""
    stats = written(_ruled(statistics(docs, carry=True)), "quality")
    return _judged(stats).where("kept").select("row.*")

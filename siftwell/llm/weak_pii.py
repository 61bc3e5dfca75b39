"""PII by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Base kinds (email, ip, card, phone) are found by pattern and check in every whole text, whatever the
model says. Texts are cut at these, at white space and at the signs of CUTS; of what is between, each run
that has a digit or an ``@`` or follows an asking word is a candidate. Labelers of three sorts vote for, against
or abstain: patterns (key-like hexadecimal or mixed runs, long digit runs, plain short numbers), gazetteers
(prefixes of issued keys, countries of bank accounts) and context (words before it). Votes make patterns, of
which there are at most 3 ** LABELERS whatever the input;
expectation-maximisation over the patterns' counts gives each labeler's reliability and each pattern's
posterior. The final classifier is a logistic regression on the candidates' own features (not the votes),
fitted to the posteriors gathered by feature pattern; of these there are at most 2 ** FEATURES.
Counts cover all candidates; only the two bounded tables come to the driver.

Spans are (kind, start, end) in code points, end exclusive. Inside, a span also has its place in bytes, by which a
part of a text is cut out without counting from its beginning; so the work is in proportion to a text
and its matches, however many there are.

Hostile cases: a null text is an empty one, without spans; no candidates at all leave the model at its
priors; runs of any length are scanned once; repeated rows count each; an empty table gives an empty
result; further columns aren't read (redact() keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import sha256_hex, written

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Each may begin where the last match ended or where its run begins, so that a run is tried once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have at least for a pattern to be tried.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: What ends a candidate: white space, quotes and the signs between the fields of JSON, CSV, lists and query strings.
CUTS = r"\x20\x09-\x0D\"'`,;:=&"
#: A candidate of the method: a run with a digit or an at sign; the padding of a long one belongs to it.
RUN = rf"(?:\G|(?<![^{CUTS}]))[^{CUTS}0-9@]*+[0-9@][^{CUTS}]*+(?:(?<=[A-Za-z0-9+/]{{16}})={{1,2}}+(?![^{CUTS}]))?+"
EXTRA = "secret"
#: Code points before a candidate that context labelers read.
BEFORE = 48

# Words before a secret or a person's number, before plain numbers, and prefixes of issued keys.
ASKING = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "credential", "auth", "bearer", "passport", "ssn", "iban", "account", "license_key"]
PLAIN = ["version", "page", "chapter", "figure", "fig", "table", "section", "vol", "no", "by-nc", "item", "line", "step", "part"]
PREFIXES = ["sk-", "pk-", "ghp_", "gho_", "akia", "asia", "xoxb-", "xoxp-", "aiza", "ya29.", "glpat-", "eyj"]
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM TN TR UA VA VG XK".split()
ASKS = r"(?i)(?:^|[^a-z])(?:" + "|".join(ASKING) + r")[\x20\x09]*[:=\"'\x20\x09]*$"
#: An asking word and the run after it, unless that asks itself; what is before the run.
ASKER = r"(?i)(?<![a-z])(?:" + "|".join(ASKING) + r")[:=\"'\x20\x09]++"
ASKED = ASKER + "(?!(?:" + "|".join(ASKING) + r")[:=\"'\x20\x09])" + f"[^{CUTS}]++"
TELLS = r"(?i)(?:^|[^a-z])(?:" + "|".join(PLAIN) + r")\.?[\x20\x09]*$"

#: Votes: 1 for, 0 against, 2 abstains.
LABELERS = ("key_like", "digits", "short", "issued", "country", "asked", "told")
FEATURES = ("long", "very_long", "digits_many", "letters", "hex", "punctuated", "mixed", "edge")
#: Reliability that a labeler starts with, how likely a candidate is one, and rounds of each fit.
START, PRIOR = 0.8, 0.2
EM_ROUNDS, FIT_ROUNDS, STEP, PENALTY = 30, 400, 0.5, 1e-3
ACCEPT = 0.5


#: Values that one array is made of by adding to it, which copies it each time.
CHUNK = 256


def _let(x: Column, then) -> Column:
    """then(x), where x is worked out once."""
    return F.transform(F.array(x), then)[0]


def _before(values: Column, merge) -> Column:
    """For each whole number, what merge (a sum, or the greatest) makes of zero and those before it."""

    def run(part: Column, first: Column) -> Column:
        none = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, none, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def whole(vs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(vs), F.lit(1)), F.lit(CHUNK))
        return _let(F.transform(starts, lambda k: F.slice(vs, k, CHUNK)), merged)

    def merged(chunks: Column) -> Column:
        firsts = run(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge)), F.lit(0))
        return F.flatten(F.zip_with(chunks, firsts, run))

    return _let(values, whole)


def _sum(a: Column, x: Column) -> Column:
    return a + x


def _most(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _spans(text: Column, pattern: str, hint: str) -> Column:
    """The matches of a pattern, leftmost and apart."""
    return F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """The matches with their places: a match begins where the texts between and the matches before end."""
    between = F.slice(F.split(text, pattern), 1, F.size(matches))
    pairs = F.zip_with(between, matches, lambda x, m: F.struct(F.length(x).alias("gap"), F.octet_length(x).alias("byte_gap"), F.length(m).alias("n"), F.octet_length(m).alias("bytes"), m.alias("m")))

    def put(x: Column, at: Column) -> Column:
        start, byte = at["at"] + x["gap"], at["byte"] + x["byte_gap"]
        return F.struct(start.alias("s"), (start + x["n"]).alias("e"), byte.alias("b"), (byte + x["bytes"]).alias("f"), x["m"].alias("m"))

    def placed(ps: Column) -> Column:
        at = _before(F.transform(ps, lambda x: x["gap"] + x["n"]), _sum)
        byte = _before(F.transform(ps, lambda x: x["byte_gap"] + x["bytes"]), _sum)
        return F.zip_with(ps, F.zip_with(at, byte, lambda a, b: F.struct(a.alias("at"), b.alias("byte"))), put)

    return _let(pairs, placed)


def _bytes(data: Column, start: Column, end: Column) -> Column:
    """The text between two places in bytes."""
    return F.substring(data, start + 1, end - start).cast("string")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """If the digits of m pass the check: from the right, every second is doubled and its digits added."""
    back = F.split(F.reverse(_digits(m)), "")
    values = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.when(F.length(part(x)) <= 3, part(x).try_cast("int")), F.lit(0)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["m"])


def _named(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _cut(kind: str):
    return lambda x: F.struct(x["b"].alias("b"), x["f"].alias("f"), F.lit(f"[{kind.upper()}]").alias("k"))


_NONE = "array<struct<s:int,e:int,b:int,f:int,m:string>>"


def _with(df: DataFrame, name: str, text: str, pattern: str, hint: str) -> DataFrame:
    """df with the placed matches of a pattern in one of its texts."""
    df = df.withColumn(f"{name}_m", _spans(F.col(text), pattern, hint))
    some = F.size(F.coalesce(F.col(f"{name}_m"), F.array().cast("array<string>"))) > 0
    return df.withColumn(name, F.when(some, _placed(F.col(text), F.col(f"{name}_m"), pattern)).otherwise(F.array().cast(_NONE))).drop(f"{name}_m")


def _rebuilt(text: Column, taken: Column, put) -> Column:
    """The text with put(span, end of those before it) for each span of taken (b, f in bytes), which is in order."""

    def run(data: Column, spans: Column) -> Column:
        ends = _before(F.transform(spans, lambda x: x["f"]), _most)

        def piece(x: Column, end: Column) -> Column:
            return F.concat(_bytes(data, end, F.greatest(end, x["b"])), put(x, end))

        parts = F.zip_with(spans, ends, piece)
        last = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["f"]))
        return F.concat(F.array_join(parts, ""), _bytes(data, last, F.octet_length(data)))

    return _let(text.cast("binary"), lambda data: _let(taken, lambda spans: run(data, spans)))


def _found(df: DataFrame) -> DataFrame:
    """df (with t, a text) and its base spans by kind and candidates, in arrays."""
    for kind in KINDS:
        df = _with(df, kind, "t", PATTERNS[kind], HINTS[kind])
    for kind in KINDS:
        df = df.withColumn(kind, F.filter(kind, _check(kind)))
    df = df.withColumn("taken", F.array_sort(F.flatten(F.array(*[F.transform(k, lambda x: F.struct(x["b"].alias("b"), x["f"].alias("f"))) for k in KINDS]))))
    # Base spans, which are ASCII, are blanked by a sign that cuts but doesn't ask; places stay as they are.
    blanks = _rebuilt(F.col("t"), F.col("taken"), lambda x, end: F.repeat(F.lit(","), F.greatest(x["f"], end) - F.greatest(x["b"], end)))
    df = df.withColumn("free", F.when(F.size("taken") > 0, blanks).otherwise(F.col("t")))
    df = _with(df, EXTRA, "free", RUN, r"[0-9@]")
    df = _with(df, "asked", "free", ASKED, ASKER)

    def run(x: Column) -> Column:
        m = F.regexp_replace(x["m"], "^" + ASKER, "")
        return F.struct((x["e"] - F.length(m)).alias("s"), x["e"].alias("e"), (x["f"] - F.octet_length(m)).alias("b"), x["f"].alias("f"), m.alias("m"))

    # Runs with a digit or an at sign are among the others.
    asked = F.filter(F.transform("asked", run), lambda x: ~x["m"].rlike("[0-9@]"))
    df = df.withColumn(EXTRA, F.when(F.size("asked") > 0, F.array_sort(F.concat(EXTRA, asked))).otherwise(F.col(EXTRA))).drop("asked", "free")
    # Quotes and stops around a run aren't of it; all of them are ASCII.
    head, tail = r"^[\"'(\[{<,;:]+", r"[\"')\]}>,;:.!?]+$"

    def bare(data: Column, x: Column) -> Column:
        inner = F.regexp_replace(x["m"], head, "")
        kept = F.regexp_replace(inner, tail, "")
        left, right = F.length(x["m"]) - F.length(inner), F.length(inner) - F.length(kept)
        byte = x["b"] + left
        before = F.right(_bytes(data, F.greatest(byte - 4 * BEFORE, F.lit(0)), byte), F.lit(BEFORE))
        return F.struct((x["s"] + left).alias("s"), (x["e"] - right).alias("e"), byte.alias("b"), (x["f"] - right).alias("f"), kept.alias("m"), before.alias("before"))

    bared = _let(F.col("t").cast("binary"), lambda data: F.transform(EXTRA, lambda x: bare(data, x)))
    none = F.array().cast("array<struct<s:int,e:int,b:int,f:int,m:string,before:string>>")
    return df.withColumn(EXTRA, F.when(F.size(EXTRA) > 0, F.filter(bared, lambda x: x["m"] != "")).otherwise(none))


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return vote.when(no, 0).otherwise(2) if no is not None else vote.otherwise(2)


def _votes(x: Column) -> dict[str, Column]:
    m, n = x["m"], F.length(x["m"])
    digits = F.length(_digits(m))
    return {
        "key_like": _vote((n >= 20) & m.rlike(r"^[0-9A-Za-z_+/=.-]+$") & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), n <= 10),
        "digits": _vote((digits >= 9) & (digits < 16) & m.rlike(r"^[0-9 ().-]+$"), (digits <= 4) | (m.rlike("^[0-9]{16,19}$") & ~_luhn(m))),
        "short": _vote(F.lit(False), n <= 6),
        "issued": _vote(F.lower(F.substring(m, 1, 6)).rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")")),
        "country": _vote(m.rlike("^(?:" + "|".join(COUNTRIES) + ")[0-9]{2}[0-9A-Z]{11,30}$")),
        "asked": _vote(x["before"].rlike(ASKS)),
        "told": _vote(F.lit(False), x["before"].rlike(TELLS)),
    }


def _features(x: Column) -> dict[str, Column]:
    m, n = x["m"], F.length(x["m"])
    digits = F.length(_digits(m))
    return {
        "long": n >= 12,
        "very_long": n >= 24,
        "digits_many": (digits >= 8) & (digits < 16),
        "letters": m.rlike("[A-Za-z]"),
        "hex": m.rlike(r"^[0-9a-fA-F]+$"),
        "punctuated": m.rlike(r"[^0-9A-Za-z_-]"),
        "mixed": m.rlike("[0-9][A-Za-z]") & m.rlike("[A-Za-z][0-9]"),
        "edge": x["before"].rlike(r"[:=][\x20\x09\"']*$"),
    }


def _packed(df: DataFrame) -> DataFrame:
    """Each candidate as s, e, v (its votes in base 3) and f (its features' bits)."""

    def code(x: Column) -> Column:
        v = F.lit(0)
        for c in _votes(x).values():
            v = v * 3 + c
        f = F.lit(0)
        for c in _features(x).values():
            f = f * 2 + F.coalesce(c, F.lit(False)).cast("int")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), x["f"].alias("f"), v.alias("votes"), f.alias("features"))

    return df.withColumn(EXTRA, F.transform(EXTRA, code))


def reliabilities(counts: dict[int, int]) -> tuple[float, list[tuple[list[float], list[float]]], dict[int, float]]:
    """(prior, for each labeler its vote shares among negatives and positives, posterior of each vote pattern).

    counts: candidates by vote pattern. Votes are taken as independent given the truth.
    """
    digits = {v: [v // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))] for v in counts}
    prior = PRIOR
    start = ([START, 1 - START, 1.0], [1 - START, START, 1.0])
    table = [start for _ in LABELERS]
    posterior: dict[int, float] = {}
    for _ in range(EM_ROUNDS):
        for v, votes in digits.items():
            no, yes = math.log(1 - prior), math.log(prior)
            for k, vote in enumerate(votes):
                no += math.log(table[k][0][vote])
                yes += math.log(table[k][1][vote])
            posterior[v] = 1 / (1 + math.exp(min(700.0, max(-700.0, no - yes))))
        total = sum(counts.values())
        if not total:
            break
        prior = min(0.95, max(0.001, sum(counts[v] * p for v, p in posterior.items()) / total))
        fresh = []
        for k in range(len(LABELERS)):
            sides = []
            for side in (0, 1):
                # Two votes of each sort that say what a labeler is taken to be at the start.
                sums = [2 * start[side][vote] for vote in range(3)]
                for v, votes in digits.items():
                    sums[votes[k]] += counts[v] * (posterior[v] if side else 1 - posterior[v])
                sides.append([x / sum(sums) for x in sums])
            fresh.append((sides[0], sides[1]))
        table = fresh
    return prior, table, posterior


def fit(cells: dict[int, tuple[float, float]]) -> list[float]:
    """Intercept and a weight for each feature, from (candidates, sum of posteriors) by feature pattern."""
    rows = [([1.0, *(float(f >> (len(FEATURES) - 1 - k) & 1) for k in range(len(FEATURES)))], n, p) for f, (n, p) in sorted(cells.items())]
    total = sum(n for _, n, _ in rows)
    weights = [0.0] * (len(FEATURES) + 1)
    if not total:
        weights[0] = math.log(PRIOR / (1 - PRIOR))
        return weights
    for _ in range(FIT_ROUNDS):
        slope = [PENALTY * w for w in weights]
        for x, n, p in rows:
            guess = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x))))
            for k, v in enumerate(x):
                slope[k] += v * (n * guess - p) / total
        weights = [w - STEP * 4 * g for w, g in zip(weights, slope)]
    return weights


def train(found: DataFrame) -> list[float]:
    """The classifier's weights from all candidates of found; two tables of bounded size come to the driver."""
    # Not explode(): the optimiser would put a filter of its own below, and find every candidate twice.
    cells = found.select(F.explode_outer(EXTRA).alias("x")).where(F.col("x").isNotNull()).groupBy(F.col("x.votes").alias("v"), F.col("x.features").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.collect()  # at most 3 ** LABELERS * 2 ** FEATURES, and far fewer as votes and features hang together
    counts: dict[int, int] = {}
    for r in rows:
        counts[r["v"]] = counts.get(r["v"], 0) + r["n"]
    _, _, posterior = reliabilities(dict(sorted(counts.items())))
    by_features: dict[int, tuple[float, float]] = {}
    for r in sorted(rows, key=lambda r: (r["f"], r["v"])):
        n, p = by_features.get(r["f"], (0.0, 0.0))
        by_features[r["f"]] = (n + r["n"], p + r["n"] * posterior[r["v"]])
    return fit(by_features)


def accepted(weights: list[float]) -> list[int]:
    """The feature patterns that the classifier takes for personal data."""
    floor = math.log(ACCEPT / (1 - ACCEPT))
    return [f for f in range(1 << len(FEATURES)) if weights[0] + sum(w for k, w in enumerate(weights[1:]) if f >> (len(FEATURES) - 1 - k) & 1) > floor]


def _scored(found: DataFrame) -> DataFrame:
    good = F.array(*[F.lit(f) for f in accepted(train(found))]).cast("array<int>")
    return found.withColumn(EXTRA, F.filter(EXTRA, lambda x: F.array_contains(good, x["features"])))


def _listed(kinds: tuple[str, ...]) -> Column:
    parts = [F.transform(k, _named(k)) for k in kinds]
    return F.array_join(F.flatten(F.array(*parts)), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and n_secret of each row of docs (doc_id, text)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = written(_packed(_found(df)).drop("t", "taken"), "spans")
    out = _scored(found)
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        sha256_hex(_listed(KINDS)).alias("base_sha256"),
        _listed((*KINDS, EXTRA)).alias("spans"),
        F.size(EXTRA).cast("long").alias(f"n_{EXTRA}"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; other columns stay as they are."""
    inner = [f"__{c}" for c in docs.columns]
    df = docs.toDF(*inner).withColumn("t", F.coalesce(F.col(f"__{text}").cast("string"), F.lit("")))
    found = _packed(_found(df))
    # The model is fitted on all candidates of this input first; then texts are read once more.
    good = F.array(*[F.lit(f) for f in accepted(train(found.select(EXTRA)))]).cast("array<int>")
    found = found.withColumn(EXTRA, F.filter(EXTRA, lambda x: F.array_contains(good, x["features"])))
    cut = F.array_sort(F.flatten(F.array(*[F.transform(k, _cut(k)) for k in (*KINDS, EXTRA)])))
    found = found.withColumn("cut", cut)
    # A span that begins within another is taken out with it.
    clean = _rebuilt(F.col("t"), F.col("cut"), lambda x, end: F.when(x["b"] >= end, x["k"]).otherwise(F.lit("")))
    found = found.withColumn(f"__{text}", F.when(F.size("cut") > 0, clean).otherwise(F.col(f"__{text}")))
    return found.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])

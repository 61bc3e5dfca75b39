"""Triples (s, p, o): selection, graph patterns, literal filters, closures and rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import relations
from siftwell.storage import forget, written

RDF_TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"


def of_documents(docs: DataFrame) -> DataFrame:
    """A triple for each property: predicate prop:type:key."""
    own = docs.select("uri", F.explode("properties").alias("x"))
    return own.select(F.col("uri").alias("s"), F.concat(F.lit("prop:"), "x.type", F.lit(":"), "x.key").alias("p"), F.col("x.value").alias("o"))


def select(triples: DataFrame, s: str | list[str] | None = None, p: str | list[str] | None = None, o: str | list[str] | None = None) -> DataFrame:
    """Triples by what is bound of subject, predicate and object; lists mean any of them."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return triples


def select_where(triples: DataFrame, s: DataFrame | None = None, p: DataFrame | None = None, o: DataFrame | None = None, filters: list[Column] = [], limit: int | None = None) -> DataFrame:  # noqa: B006
    """Triples whose parts are among those of tables of one column each, and that literal filters of o leave."""
    for name, among in (("s", s), ("p", p), ("o", o)):
        if among is not None:
            triples = triples.join(among.toDF(name).distinct(), name, "left_semi")
    for f in filters:
        triples = triples.where(f)
    return triples.select("s", "p", "o") if limit is None else triples.select("s", "p", "o").limit(limit)


def contains(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> bool:
    return bool(select(triples, s, p, o).limit(1).count())


def subjects(triples: DataFrame, p: str, o: str) -> DataFrame:
    """The distinct subjects that have a predicate and object."""
    return select(triples, p=p, o=o).select("s").distinct()


def objects(triples: DataFrame, s: str, p: str) -> DataFrame:
    return select(triples, s=s, p=p).select("o").distinct()


def is_literal(o: Column) -> Column:
    """If an object is a text and not a thing; things have a prefix, a bracketed address or are blank."""
    return ~o.rlike(r"^(?:_:|<[^>]*>$|[A-Za-z][A-Za-z0-9_.-]*:[^\s]+$)")


def entities(triples: DataFrame) -> DataFrame:
    """The distinct things that are subjects or objects."""
    return triples.select("s").union(triples.where(~is_literal(F.col("o"))).select("o")).distinct()


def predicates(triples: DataFrame) -> DataFrame:
    return triples.select("p").distinct()


def metas(triples: DataFrame) -> DataFrame:
    """The distinct graphs that triples are in (column g; one without a name if there's none)."""
    return triples.select("g").distinct() if "g" in triples.columns else triples.select(F.lit("").alias("g")).distinct()


def of_type(triples: DataFrame, cls: str) -> DataFrame:
    """The distinct subjects of a type, without inference."""
    return subjects(triples, RDF_TYPE, cls)


LINK = "text:link"


def links(docs: DataFrame) -> DataFrame:
    """A triple for each link of a document (uri and links)."""
    return docs.select(F.col("uri").alias("s"), F.lit(LINK).alias("p"), F.explode(F.array_distinct("links")).alias("o"))


def to_documents(triples: DataFrame) -> DataFrame:
    """uri and properties of the triples that of_documents() makes."""
    parts = F.split("p", ":", 3)
    own = triples.where(F.col("p").startswith("prop:")).select(F.col("s").alias("uri"), F.struct(parts[1].alias("type"), parts[2].alias("key"), F.col("o").alias("value")).alias("x"))
    return own.groupBy("uri").agg(F.array_sort(F.collect_list("x")).alias("properties"))


def converted(triples: DataFrame, subject: Callable[[Column], Column] | None = None, obj: Callable[[Column], Column] | None = None) -> DataFrame:
    """Triples with a caller's own forms of subjects and objects."""
    changes = {name: f(F.col(name)) for name, f in (("s", subject), ("o", obj)) if f is not None}
    return triples.withColumns(changes) if changes else triples


def renamed(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Triples with the beginnings of addresses replaced, the longest that fits: to abbreviate, or to expand."""
    order = sorted(prefixes, key=len, reverse=True)

    def one(c: str) -> Column:
        out = F.lit(None).cast("string")
        for old in reversed(order):
            out = F.when(F.col(c).startswith(old), F.concat(F.lit(prefixes[old]), F.substring(F.col(c), len(old) + 1, 1 << 20))).otherwise(out)
        return F.coalesce(out, F.col(c))

    return triples.withColumns({c: one(c) for c in "spo"})


def match(triples: DataFrame, patterns: list[tuple], distinguished: list[str], filters: list[Column] = []) -> DataFrame:  # noqa: B006
    """The distinct bindings of a graph pattern; names that begin with ? are variables.

    Patterns are natural joins on the variables that they share, as given; Catalyst orders them. Those whose predicate is
    math:name are worked out on the bindings of those before: a new object (or subject, turned round) becomes a
    column, bound ones are tested. Their subject is a variable, a number, or a tuple of these.
    """

    def one(pattern: tuple) -> DataFrame:
        found, seen, again = triples, {}, []
        for name, x in zip("spo", pattern):
            if not x.startswith("?"):
                found = found.where(F.col(name) == x)
            elif x[1:] in seen:
                again.append(F.col(name) == F.col(seen[x[1:]]))
            else:
                seen[x[1:]] = name
        for test in again:
            found = found.where(test)
        return found.select(*[F.col(c).alias(v) for v, c in seen.items()])

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("patterns must share a variable with those before them")
        return a.join(b, shared)

    def term(x) -> Column:
        if isinstance(x, tuple):
            return F.array(*[term(y).cast("string") for y in x])
        return F.col(x[1:]) if isinstance(x, str) and x.startswith("?") else F.lit(str(x))

    def related(found: DataFrame, s, name: str, o) -> DataFrame:
        def new(x) -> bool:
            return isinstance(x, str) and x.startswith("?") and x[1:] not in found.columns

        if new(o):
            return found.withColumn(o[1:], relations.value(name, term(s))).where(F.col(o[1:]).isNotNull())
        if new(s):
            return found.withColumn(s[1:], relations.subject_of(name, term(o))).where(F.col(s[1:]).isNotNull())
        return found.where(relations.holds(name, term(s), term(o)))

    plain = [p for p in patterns if not p[1].startswith(relations.PREFIX)]
    found = reduce(joined, [one(p) for p in plain])
    for s, p, o in patterns:
        if p.startswith(relations.PREFIX):
            found = related(found, s, p.removeprefix(relations.PREFIX), o)
    for f in filters:
        found = found.where(f)
    return found.select(*distinguished).distinct()


def literal_filter(column: str, op: str, value: str | float) -> Column:
    """A comparison of a literal: numbers as numbers, texts as texts."""
    c = F.col(column) if isinstance(value, str) else F.col(column).try_cast("double")
    v = F.lit(value)
    return {"lt": c < v, "le": c <= v, "eq": c == v, "ne": c != v, "ge": c >= v, "gt": c > v, "contains": F.col(column).contains(v), "starts": F.col(column).startswith(v), "ends": F.col(column).endswith(v)}[op]


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of a that b doesn't have."""
    return a.join(b.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """All (a, b) along edges (a, b): the pairs that the last round has found go on by one edge until none is new."""
    steps = written(edges.select("a", "b").distinct(), "edges")
    known, new = steps, steps
    while new.limit(1).count():
        onward = new.select("a", F.col("b").alias("via")).join(steps.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        new = written(onward.join(known, ["a", "b"], "left_anti"), "paths")
        known = known.union(new)
    return known


def reached(edges: DataFrame, starts: DataFrame, column: str = "node") -> DataFrame:
    """The nodes that edges (a, b) lead to from starts, and these: only what is met is walked."""
    known = new = written(starts.select(F.col(column).alias("node")).distinct(), "reached")
    while new.limit(1).count():
        onward = edges.join(new, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        new = written(onward.join(known, "node", "left_anti"), "reached")
        known = known.union(new)
    return known


def instances(triples: DataFrame, cls: str) -> DataFrame:
    """s of what is an instance of a class: by its subclasses, and by domains and ranges of its properties and their
    subproperties. Walks down from the class."""
    down = select(triples, p=SUBCLASS).select(F.col("o").alias("a"), F.col("s").alias("b"))
    wanted = reached(down, triples.sparkSession.createDataFrame([(cls,)], "node string")).select(F.col("node").alias("cls"))
    typed = select(triples, p=RDF_TYPE).join(wanted, F.col("o") == F.col("cls"), "left_semi").select("s")
    narrower = select(triples, p=SUBPROPERTY).select(F.col("o").alias("a"), F.col("s").alias("b"))

    def having(kind: str) -> DataFrame:
        own = select(triples, p=kind).join(wanted, F.col("o") == F.col("cls"), "left_semi").select(F.col("s").alias("node"))
        return reached(narrower, own).select(F.col("node").alias("prop"))

    by_start = triples.join(having(DOMAIN), F.col("p") == F.col("prop"), "left_semi").select("s")
    by_end = triples.join(having(RANGE), F.col("p") == F.col("prop"), "left_semi").select(F.col("o").alias("s"))
    return typed.union(by_start).union(by_end).distinct()


def with_subproperties(triples: DataFrame, p: str) -> DataFrame:
    """Triples of a predicate and of those below it, as of the predicate itself."""
    narrower = select(triples, p=SUBPROPERTY).select(F.col("o").alias("a"), F.col("s").alias("b"))
    wanted = reached(narrower, triples.sparkSession.createDataFrame([(p,)], "node string"))
    return triples.join(wanted, F.col("p") == F.col("node"), "left_semi").select("s", F.lit(p).alias("p"), "o").distinct()


Rule = tuple[list[tuple[str, str, str]], tuple[str, str, str]]


def fixpoint(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """Triples with all that the rules (body patterns, head) give, forward until nothing is new.

    A round joins what the last one has found with all that is known, once for each pattern of a body that may be
    of it; each round's new triples are a written table.
    """
    known = new = written(triples.select("s", "p", "o").distinct(), "facts")
    while new.limit(1).count():
        found = []
        for body, head in rules:
            names = list(dict.fromkeys(x[1:] for x in head if x.startswith("?")))
            for k in range(len(body)):
                # The pattern that meets what is new comes first.
                marked = new.select("s", "p", "o", F.lit(True).alias("fresh")).union(known.select("s", "p", "o", F.lit(False)))
                bound = _bound(marked, body[k], True)
                rest = [x for j, x in enumerate(body) if j != k]
                while rest:
                    nxt = next(x for x in rest if any(y.startswith("?") and y[1:] in bound.columns for y in x))
                    rest.remove(nxt)
                    part = _bound(marked, nxt, False)
                    bound = bound.join(part, [c for c in bound.columns if c in part.columns])
                found.append(bound.select(*[(F.col(x[1:]) if x.startswith("?") else F.lit(x)).alias(c) for x, c in zip(head, "spo")]).distinct())
                assert set(names) <= set(bound.columns), "a head's variables must be in its body"
        more = reduce(DataFrame.union, found).distinct().join(known, ["s", "p", "o"], "left_anti")
        new = written(more.select("s", "p", "o"), "facts")
        known = known.union(new)
    return known


def _bound(marked: DataFrame, pattern: tuple[str, str, str], fresh: bool) -> DataFrame:
    """The bindings of one pattern, by new triples or by all that are known."""
    found = marked.where(F.col("fresh") if fresh else ~F.col("fresh"))
    seen: dict[str, str] = {}
    for name, x in zip("spo", pattern):
        if not x.startswith("?"):
            found = found.where(F.col(name) == x)
        elif x[1:] in seen:
            found = found.where(F.col(name) == F.col(seen[x[1:]]))
        else:
            seen[x[1:]] = name
    return found.select(*[F.col(c).alias(v) for v, c in seen.items()]).distinct()


def connected(triples: DataFrame) -> DataFrame:
    """node, part: the least node that each thing hangs together with, over triples in any direction."""
    edges = triples.where(~is_literal(F.col("o")) & (F.col("s") != F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b"))
    both = written(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    parts = written(triples.select(F.col("s").alias("node")).union(both.select("a")).distinct().withColumn("part", F.col("node")), "parts")
    while True:
        near = both.join(parts, F.col("b") == F.col("node")).groupBy("a").agg(F.min("part").alias("low"))
        low = parts.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("part").alias("was"), F.least("part", F.coalesce("low", "part")).alias("part"))
        # And by the part of the part, so that rounds are few.
        up = parts.select(F.col("node").alias("part"), F.col("part").alias("above"))
        nxt = written(low.join(up, "part", "left").select("node", "was", F.least("part", F.coalesce("above", "part")).alias("part")), "parts")
        moved = nxt.where(F.col("was") != F.col("part")).limit(1).count()
        forget(parts)
        parts = nxt
        if not moved:
            return parts.select("node", "part")


def self_contained(triples: DataFrame) -> DataFrame:
    """Triples with the part each is of when what hangs together by blank things (_:) is kept together: the least of its
    blank things, or none where it has none."""
    blank = triples.where(F.col("s").startswith("_:") & F.col("o").startswith("_:"))
    parts = connected(blank)
    parts = parts.select(F.col("node").alias("__node"), F.col("part").alias("__part"))
    key = F.when(F.col("s").startswith("_:"), F.col("s")).when(F.col("o").startswith("_:"), F.col("o"))
    found = triples.withColumn("__key", key).join(parts, F.col("__key") == F.col("__node"), "left")
    return found.select("s", "p", "o", F.coalesce("__part", "__key").alias("part"))


def _digest(x: Column) -> list[Column]:
    """Aggregates that tell sets of texts apart: the sums of the eight words of each text's SHA-256."""
    words = F.sha2(x, 256)
    return [F.sum(F.conv(F.substring(words, 8 * k + 1, 8), 16, 10).cast("bigint")).alias(f"h{k}") for k in range(8)]


def lean(triples: DataFrame) -> DataFrame:
    """Triples without those of blank subjects that say no more than another subject does.

    A blank thing that no triple points to goes if all its predicates and objects are another's (of equals all but the
    least). Subjects that say the same are found by a digest of all they say, so that one of each kind goes on; of these
    candidates are such as say more and share the rarest triple. One that has a triple which none of these says is out first.
    """
    text = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    own = triples.where(F.col("s").isNotNull()).select("s", F.col("o").alias("__o"), F.concat(text("p"), text("o")).alias("said")).distinct()
    pointed = own.select(F.col("__o").alias("s")).where(F.col("s").startswith("_:")).distinct().withColumn("pointed", F.lit(True))
    sizes = own.groupBy("s").agg(F.count(F.lit(1)).alias("size"), *_digest(F.col("said")))
    free = F.col("s").startswith("_:") & F.col("pointed").isNull()
    subjects = written(sizes.join(pointed, "s", "left").select("s", "size", free.alias("free"), F.array(*[f"h{k}" for k in range(8)]).alias("kind")), "subjects")
    # Of equals a thing with a name stays before all blank ones.
    kept = F.min(F.struct(F.col("s").startswith("_:").alias("blank"), "s"))["s"]
    kinds = written(subjects.groupBy("kind", "size").agg(kept.alias("s"), F.max("free").alias("free")), "kinds")
    facts = written(own.select("s", "said").join(kinds.select("s", "size", "free"), "s"), "facts")
    counts = facts.groupBy("said").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"))
    wanted = facts.where("free").join(counts, "said")
    rarest = wanted.groupBy("s", "size").agg(F.min_by("said", F.struct("n", "said")).alias("said"), F.min("largest").alias("largest")).where("largest > size")
    others = facts.select(F.col("s").alias("t"), "said", F.col("size").alias("whole"))
    pairs = rarest.join(others, "said").where("whole > size").select("s", "t", "size")
    shared = pairs.join(facts.select("s", "said"), "s").join(others.select("t", "said"), ["t", "said"]).groupBy("s", "t", "size").agg(F.count(F.lit(1)).alias("same")).where("same = size")
    under = kinds.join(shared, "s", "left_semi").select("kind", F.lit(True).alias("under"))
    least = kinds.select("kind", F.col("s").alias("least"))
    gone = subjects.where("free").join(least, "kind").join(under, "kind", "left").where((F.col("s") != F.col("least")) | F.col("under")).select("s")
    return triples.join(gone, "s", "left_anti")


# --- rules that come with the engine ---------------------------------------------------------------------------------

#: Mails of a thread: each refers to the one it answers, and what those refer to is of the thread too.
THREAD_RULES: list[Rule] = [
    ([("?a", "prop:k:fixme:reference", "?b")], ("?a", "in_thread", "?b")),
    ([("?a", "in_thread", "?b"), ("?b", "in_thread", "?c")], ("?a", "in_thread", "?c")),
]
#: Whoever a mail is sent or copied to gets it.
RECIPIENT_RULES: list[Rule] = [([("?m", "prop:k:fixme:to", "?x")], ("?m", "recipient", "?x")), ([("?m", "prop:k:fixme:cc", "?x")], ("?m", "recipient", "?x"))]

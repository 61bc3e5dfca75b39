"""A stored index: segments of documents, postings and vocabulary, commits that name them, and searches on them by joins.

A segment is a folder with three tables: documents (as they were given), postings (field, term, uri and the positions in
it, in as many files as their bytes ask for; sorted by field and term, so that a term's rows are found by the files'
statistics) and vocab (field, term, df, cf). A commit is a
small file that lists segments and the tables of URIs deleted from each; the one of the greatest number holds, so
readers see a whole state. Fields are Text, PropertyText and PropertyKeyword (what is searched without a field)
and prop:t:, prop:k: and prop:d: with a key. Queries become semi-joins, anti-joins and unions of URIs; words, phrases
and ranges read only their terms' rows, and statistics come from the vocabulary.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.analysis import MAX_FIELD_LENGTH, Analyzer, tokens
from siftwell.functions.arrays import groups
from siftwell.functions.scalar import levenshtein_similarity, wildcard_regex
from siftwell.operators.match import Matcher, normal
from siftwell.plans.parts import PROHIBITED, And, DateRange, Fuzzy, MatchAll, MultiPhrase, Or, Part, Prefix, Property, Query, Text, TermRange, Uri, Wildcard
from siftwell.storage import file_system

TEXT, PROPERTY_TEXT, PROPERTY_KEYWORD = "Text", "PropertyText", "PropertyKeyword"
#: Bytes and rows that a task takes of a stored table, documents or postings.
TASK_BYTES, TASK_DOCUMENTS, TASK_POSTINGS = 16 << 20, 50_000, 1_000_000
#: So many terms of a pattern are named in a filter; more are joined.
NAMED_TERMS = 1000


def lists(docs: DataFrame, analyzer: Analyzer, most: int | None = None) -> DataFrame:
    """field, term, uri, positions of documents, a row for each term of a field; of a field at most the first most terms.

    Places are sorted within their document, so that nothing is shuffled.
    """
    cut = (lambda ts: F.slice(ts, 1, most)) if most else (lambda ts: ts)
    own = F.filter("properties", lambda p: p["type"] == "t")
    searched = F.flatten(F.transform(F.filter(own, lambda p: p["searched"]), lambda p: analyzer.column(p["value"])))
    lists = F.concat(
        F.array(F.struct(F.lit(TEXT).alias("field"), cut(analyzer.column(F.col("text"))).alias("terms")), F.struct(F.lit(PROPERTY_TEXT).alias("field"), cut(searched).alias("terms"))),
        F.transform(own, lambda p: F.struct(F.concat(F.lit("prop:t:"), p["key"]).alias("field"), cut(analyzer.column(p["value"])).alias("terms"))),
        F.transform(F.filter("properties", lambda p: p["type"] != "t"), lambda p: F.struct(F.concat_ws(":", F.lit("prop"), p["type"], p["key"]).alias("field"), F.array(normal(p["key"], p["value"])).alias("terms"))),
        F.transform(F.filter("properties", lambda p: (p["type"] == "k") & p["searched"]), lambda p: F.struct(F.lit(PROPERTY_KEYWORD).alias("field"), F.array(normal(p["key"], p["value"])).alias("terms"))),
    )
    fields = docs.select("uri", F.explode_outer(lists).alias("x")).select("uri", "x.field", "x.terms")
    placed = F.sort_array(F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    found = fields.select("field", "uri", F.explode_outer(groups(placed, "term", ["pos"])).alias("x"))
    return found.where(F.col("x.term").isNotNull()).select("field", "x.term", "uri", F.col("x.pos").alias("positions"))


def _repeated(docs: DataFrame) -> bool:
    """If documents share a URI."""
    return docs.groupBy("uri").count().where("count > 1").limit(1).count() > 0


class Index:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer, most: int | None = MAX_FIELD_LENGTH) -> None:
        """most: of each field so many terms are taken; None for all."""
        self.spark, self.path, self.analyzer, self.most = spark, path.rstrip("/"), analyzer, most

    # --- commits

    def _commits(self) -> list[int]:
        at, files = file_system(self.spark, f"{self.path}/commits")
        if not files.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())

    def segments(self, commit: int | None = None) -> list[dict]:
        """The segments of a commit, the last if none is named: name, and the tables of deleted URIs."""
        known = self._commits()
        if not known:
            return []
        at, files = file_system(self.spark, f"{self.path}/commits/{known[-1] if commit is None else commit}")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _commit(self, segments: list[dict]) -> None:
        known = self._commits()
        at, files = file_system(self.spark, f"{self.path}/commits/{known[-1] + 1 if known else 1}")
        stream = files.create(at, False)  # fails if another writer has been faster
        try:
            stream.write(bytearray(json.dumps(segments).encode("utf-8")))
        finally:
            stream.close()

    # --- writing

    def add(self, docs: DataFrame, parts: int = 64) -> None:
        """A new segment of at least so many files of postings; documents whose URIs are there already aren't looked for."""
        name = f"segment-{uuid.uuid4().hex}"
        docs.write.parquet(f"{self.path}/{name}/documents")
        stored = self.spark.read.parquet(f"{self.path}/{name}/documents")
        tasks = self._tasks(f"{name}/documents", stored.count(), TASK_DOCUMENTS)
        dealt = stored if stored.rdd.getNumPartitions() >= tasks else stored.repartition(tasks, "uri")
        loose = f"{self.path}/{name}/loose"
        lists(dealt, self.analyzer, self.most).write.parquet(loose)
        found = self.spark.read.parquet(loose)
        parts = max(parts, self._tasks(f"{name}/loose", found.count(), TASK_POSTINGS))
        found.repartitionByRange(parts, "field", "term", "uri").sortWithinPartitions("field", "term", "uri").write.parquet(f"{self.path}/{name}/postings")
        at, files = file_system(self.spark, loose)
        files.delete(at, True)
        within = self.spark.read.parquet(f"{self.path}/{name}/postings").select("field", "term", "uri", F.size("positions").alias("n"))
        if _repeated(stored):
            within = within.groupBy("field", "term", "uri").agg(F.sum("n").alias("n"))
        vocab = within.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
        vocab.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{self.path}/{name}/vocab")
        self._commit([*self.segments(), {"name": name, "deleted": []}])

    def _tasks(self, table: str, rows: int, most: int) -> int:
        """How many tasks a table of so many rows asks for, with at most so many rows each."""
        at, files = file_system(self.spark, f"{self.path}/{table}")
        return max(math.ceil(files.getContentSummary(at).getLength() / TASK_BYTES), math.ceil(rows / most))

    def delete(self, uris: DataFrame) -> None:
        """Take documents and their children out of all segments there are."""
        name = f"deleted-{uuid.uuid4().hex}"
        uris.select("uri").distinct().write.parquet(f"{self.path}/{name}")
        self._commit([{**s, "deleted": [*s["deleted"], name]} for s in self.segments()])

    def update(self, docs: DataFrame, parts: int = 64) -> None:
        self.delete(docs.select("uri"))
        self.add(docs, parts)

    def optimize(self, parts: int = 64) -> None:
        """One segment without what is deleted."""
        whole, before = self.documents(), self.segments()
        if len(before) > 1 or any(s["deleted"] for s in before):
            self.add(whole, parts)
            self._commit([self.segments()[-1]])

    def add_index(self, other: Index, parts: int = 64) -> None:
        """Another index's documents whose URIs aren't there yet."""
        mine = self.documents().select("uri")
        self.add(other.documents().join(mine, "uri", "left_anti"), parts)

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete all commits but the last ones, and what no commit names any more; the names of what went."""
        known = self._commits()
        named = {n for c in known[-keep:] for s in self.segments(c) for n in (s["name"], *s["deleted"])}
        top, files = file_system(self.spark, self.path)
        gone = [s.getPath().getName() for s in files.listStatus(top) if s.getPath().getName() not in named | {"commits"}]
        for name in gone:
            files.delete(file_system(self.spark, f"{self.path}/{name}")[0], True)
        for c in known[:-keep]:
            files.delete(file_system(self.spark, f"{self.path}/commits/{c}")[0], False)
        return gone

    # --- reading

    def _living(self, table: str, segment: dict) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{segment['name']}/{table}")
        for name in segment["deleted"]:
            gone = self.spark.read.parquet(f"{self.path}/{name}").select(F.col("uri").alias("__gone"))
            df = df.join(gone, F.col("uri") == F.col("__gone"), "left_anti")
            if "parent_uri" in df.columns:
                df = df.join(gone, F.col("parent_uri") == F.col("__gone"), "left_anti")
            elif table != "documents":
                child = self.spark.read.parquet(f"{self.path}/{segment['name']}/documents").select(F.col("uri").alias("__child"), "parent_uri")
                df = df.join(child.join(gone, F.col("parent_uri") == F.col("__gone")).select("__child"), F.col("uri") == F.col("__child"), "left_anti")
        return df

    def _all(self, table: str) -> DataFrame:
        found = [self._living(table, s) for s in self.segments()]
        if not found:
            raise ValueError(f"nothing is committed in {self.path}")
        return reduce(DataFrame.unionByName, found)

    def documents(self, fields: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
        """The documents; of named columns only, and with the properties of named keys only."""
        df = self._all("documents")
        if keys is not None:
            df = df.withColumn("properties", F.filter("properties", lambda p: p["key"].isin(keys)))
        return df if fields is None else df.select(*dict.fromkeys(["uri", *fields]))

    def first(self, key: str) -> DataFrame:
        """uri and value of each document's first property of a key."""
        return self.documents(["properties"]).select("uri", F.get(F.filter("properties", lambda p: p["key"] == key), 0)["value"].alias("value")).where(F.col("value").isNotNull())

    def sizes(self) -> DataFrame:
        """uri, key and bytes of each property, without the values."""
        return self.documents(["properties"]).select("uri", F.explode("properties").alias("p")).select("uri", "p.key", F.octet_length("p.value").alias("bytes"))

    def zipped(self, other: DataFrame) -> DataFrame:
        """The documents with another table's columns beside theirs, by URI."""
        return self.documents().join(other, "uri", "left")

    def lists(self, test: Column | None = None) -> DataFrame:
        """field, term, uri, positions."""
        df = self._all("postings")
        return df if test is None else df.where(test)

    def postings(self, test: Column | None = None) -> DataFrame:
        """field, term, uri, pos: a row for each position."""
        return self.lists(test).select("field", "term", "uri", F.explode("positions").alias("pos"))

    def positions(self, words: list[str], field: str = TEXT) -> DataFrame:
        """uri and pos of any of several terms, merged."""
        return self.postings((F.col("field") == field) & F.col("term").isin(words)).select("uri", "pos").distinct()

    def vocab(self) -> DataFrame:
        """field, term, df and cf: of what is deleted too, until optimize()."""
        found = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{s['name']}/vocab") for s in self.segments()])
        return found.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def vectors(self) -> DataFrame:
        """uri, term, tf, positions, and (start, end) in the text of each term of each document's text, letters in lower case."""
        docs = self.documents(["text"])
        own = groups(F.sort_array(tokens(F.col("text"))), "term", ["position", "start", "end"])
        found = docs.select("uri", F.explode_outer(own).alias("x")).where(F.col("x").isNotNull()).select("uri", "x.*")
        if _repeated(docs):
            found = found.groupBy("uri", "term").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("position", "start", "end")))).alias("x")).select("uri", "term", "x.position", "x.start", "x.end")
        return found.select("uri", "term", F.size("position").alias("tf"), F.col("position").alias("positions"), F.arrays_zip("start", "end").alias("offsets"))

    def count(self) -> int:
        return self.documents(["uri"]).count()

    # --- searching

    def search(self, query: Query | Part) -> DataFrame:
        """The distinct URIs that match."""
        return self._tree(query.parts if isinstance(query, Query) else [query])

    def _tree(self, parts: list[Part]) -> DataFrame:
        required = [f for p in parts if p.logic != PROHIBITED and (f := self._part(p)) is not None]
        barred = [f for p in parts if p.logic == PROHIBITED and (f := self._part(p)) is not None]
        if not required:
            return self.documents(["uri"]).limit(0)
        found = reduce(lambda a, b: a.join(b, "uri", "left_semi"), required)
        return reduce(lambda a, b: a.join(b, "uri", "left_anti"), barred, found)

    def _with(self, test: Column) -> DataFrame:
        return self.lists(test).select("uri").distinct()

    def _phrase(self, field: str, words: list[list[str]]) -> DataFrame:
        """URIs with the words one after another; the rarest word's rows aren't looked for, as the optimiser joins by size."""
        own = [self.postings((F.col("field") == field) & (F.col("term") == ws[0] if len(ws) == 1 else F.col("term").isin(ws))).select("uri", (F.col("pos") - k).alias("start")) for k, ws in enumerate(words)]
        return reduce(lambda a, b: a.join(b, ["uri", "start"], "left_semi"), own).select("uri").distinct()

    def _near(self, field: str, words: list[str], slop: int) -> DataFrame:
        """URIs whose words are within slop moves of a phrase: of each beginning, the next of every word."""
        own = reduce(DataFrame.unionByName, [self.postings((F.col("field") == field) & (F.col("term") == w)).select("uri", (F.col("pos") - k).alias("start"), F.lit(k).alias("word")) for k, w in enumerate(words)])
        w = Window.partitionBy("uri").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        nexts = [F.min(F.when(F.col("word") == k, F.col("start"))).over(w).alias(f"n{k}") for k in range(len(words))]
        found = own.select("uri", "start", *nexts)
        whole = reduce(lambda a, b: a & b, [F.col(f"n{k}").isNotNull() for k in range(len(words))])
        last = F.greatest(*[f"n{k}" for k in range(len(words))])
        return found.where(whole & (last - F.col("start") <= slop)).select("uri").distinct()

    def _terms(self, fields: list[str], test: Column) -> DataFrame:
        """URIs of the terms of the vocabulary that pass a test; the vocabulary is read, not the postings, to find them."""
        chosen = self.vocab().where(F.col("field").isin(fields) & test).select("field", "term")
        named = chosen.limit(NAMED_TERMS + 1).collect()
        if len(named) > NAMED_TERMS:
            return self.lists(F.col("field").isin(fields)).join(chosen, ["field", "term"], "left_semi").select("uri").distinct()
        return self._with(reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("term").isin([r["term"] for r in named if r["field"] == f]) for f in fields]))

    def _part(self, p: Part) -> DataFrame | None:
        """The URIs of a part; None if it has nothing to ask for and is left out."""
        every = [TEXT, PROPERTY_TEXT, PROPERTY_KEYWORD]
        if isinstance(p, Text):
            words = self.analyzer.terms(p.text)
            if not words or not (p.full_text or p.properties):
                return None
            one = (lambda f: self._near(f, words, p.slop)) if p.slop and len(words) > 1 else (lambda f: self._phrase(f, [[w] for w in words]))
            found = [one(f) for f, asked in ((TEXT, p.full_text), (PROPERTY_TEXT, p.properties)) if asked]
            if p.properties:
                found.append(self._with((F.col("field") == PROPERTY_KEYWORD) & (F.col("term") == p.text.lower())))
            return reduce(DataFrame.union, found).distinct()
        if isinstance(p, MultiPhrase):
            return self._phrase(TEXT, p.words)
        if isinstance(p, Wildcard):
            return self._terms(every, F.col("term").rlike(wildcard_regex(p.pattern.lower())))
        if isinstance(p, Prefix):
            return self._terms(every, F.col("term").startswith(p.prefix))
        if isinstance(p, Fuzzy):
            near = F.col("term").startswith(p.term[: p.prefix]) & (levenshtein_similarity(F.col("term"), p.term, p.prefix) > p.similarity)
            return self._terms([f"prop:t:{p.key}" if p.key else TEXT], near)
        if isinstance(p, TermRange):
            low = F.lit(True) if p.low is None else (F.col("term") >= p.low if p.inclusive else F.col("term") > p.low)
            high = F.lit(True) if p.high is None else (F.col("term") <= p.high if p.inclusive else F.col("term") < p.high)
            return self._terms([f"prop:t:{p.key}" if p.key else TEXT], low & high)
        if isinstance(p, Property) and p.kind == "t" and p.key != "_all":
            words = self.analyzer.terms(p.value)
            if not words:
                return None
            field = f"prop:t:{p.key}"
            return self._near(field, words, p.slop) if p.slop and len(words) > 1 else self._phrase(field, [[w] for w in words])
        if isinstance(p, Property) and p.kind != "t":
            wanted = p.value if p.key.startswith("_private:") else p.value.lower()
            field = PROPERTY_KEYWORD if p.key == "_all" and p.kind == "k" else f"prop:{p.kind}:{p.key}"
            return self._with((F.col("field") == field) & (F.col("term") == wanted))
        if isinstance(p, Or):
            found = [f for x in p.parts if (f := self._part(x)) is not None]
            if not found:
                return None
            both = reduce(DataFrame.union, found)
            return both.distinct() if p.least <= 1 else both.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.least).select("uri")
        if isinstance(p, And):
            return self._tree(p.parts)
        if isinstance(p, MatchAll):
            return self.documents(["uri"])
        if isinstance(p, (Uri, DateRange, Property)):
            # What the documents' own columns tell.
            return self.documents(["ts", "properties"]).where(Matcher(self.analyzer).part(p)).select("uri")
        raise TypeError(f"no such part: {p!r}")

    def scored(self, hits: DataFrame, words: list[str]) -> DataFrame:
        """uri and score of hits: the sum over words of sqrt(tf) * (ln(N / (df + 1)) + 1), by the vocabulary's statistics.

        A row for each distinct word is broadcast.
        """
        times = {w: words.count(w) for w in dict.fromkeys(words)}
        own = (F.col("field") == TEXT) & F.col("term").isin(list(times))
        idf = self.vocab().where(own).select("term", (F.log(F.lit(float(self.count())) / (F.col("df") + 1)) + 1).alias("idf"))
        counts = self.lists(own).join(hits.select("uri"), "uri", "left_semi").groupBy("uri", "term").agg(F.sum(F.size("positions")).alias("tf"))
        again = F.create_map(*[F.lit(x) for w, n in times.items() for x in (w, n)])
        scores = counts.join(F.broadcast(idf), "term").groupBy("uri").agg(F.sum(F.sqrt("tf") * F.col("idf") * again[F.col("term")]).alias("score"))
        return hits.select("uri").join(scores, "uri", "left").select("uri", F.coalesce("score", F.lit(0.0)).alias("score"))

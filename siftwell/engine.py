"""The engine as one object: search, count, snippets, dumps, and changes; and a command line for it."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.analysis import MAX_FIELD_LENGTH, SIMPLE, Analyzer
from siftwell.operators import changes, match, rank
from siftwell.operators.index import Index
from siftwell.operators.snippets import snippets
from siftwell.plans import human
from siftwell.plans.parts import Part, Property, Query
from siftwell.sources import files, registry

# Scopes that narrow a query to a kind of document, as what a person would type.
SCOPES = {
    "documents": "filetype:document", "archives": "filetype:archive", "pictures": "filetype:image", "media": "filetype:audio OR filetype:video", "source": "filetype:source",
    "files": "type:File", "mail": "type:MailMessage", "chats": "type:IMLog", "feeds": "type:FeedItem", "notes": "type:Note", "web": "type:WebHistory", "contacts": "type:Contact", "events": "type:Calendar", "applications": "filetype:application", "packages": "filetype:package",
}
_COLUMNS = {"type": "hit_type", "filetype": "file_type", "mimetype": "mime_type"}


class Engine:
    def __init__(self, docs: DataFrame, analyzer: Analyzer = SIMPLE) -> None:
        """docs: uri, parent_uri, ts, source, domain, hit_type, mime_type, text and properties."""
        self.docs, self.analyzer = docs, analyzer
        self.matcher = match.Matcher(analyzer)

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer = SIMPLE) -> Engine:
        return cls(Index(spark, path, analyzer).documents(), analyzer)

    def build(self, path: str, parts: int = 64, max_field_length: int | None = MAX_FIELD_LENGTH) -> Index:
        """Write an index of the documents; of each field the first max_field_length terms, or all (None)."""
        index = Index(self.docs.sparkSession, path, self.analyzer, max_field_length)
        index.add(self.docs, parts)
        return index

    def query(self, text: str | Query | Part, scope: str | None = None) -> Query:
        found = text if isinstance(text, Query) else human.parse(text) if isinstance(text, str) else Query([text])
        if scope:
            found = replace(found, parts=[*found.parts], extra={**found.extra, "scope": SCOPES[scope]})
        return found

    def matches(self, text: str | Query | Part, scope: str | None = None, uris: DataFrame | None = None) -> DataFrame:
        """All that match, of uris only if these are given."""
        query, docs = self.query(text, scope), self.docs
        if "scope" in query.extra:
            ok = F.lit(False)
            for ask in query.extra["scope"].split(" OR "):
                key, _, value = ask.partition(":")
                if _COLUMNS[key] in docs.columns:
                    ok = ok | (F.col(_COLUMNS[key]) == value)
            docs = docs.where(ok)
        if uris is not None:
            docs = docs.join(uris.select("uri"), "uri", "left_semi")
        return self.matcher.search(match.analyzed(docs, self.analyzer), query)

    def search(self, text: str | Query | Part, max_hits: int = 100, scope: str | None = None, per_source: bool = True) -> DataFrame:
        """The latest hits, of each source or of all, with their scores and without the terms they were found by."""
        query = self.query(text, scope)
        hits = self.matches(query, scope)
        top = rank.recent_per_source(hits, max_hits) if per_source else rank.recent(hits, max_hits)
        scored = rank.scored(top, match.analyzed(self.docs, self.analyzer), human.search_terms(query, self.analyzer.terms))
        visible = F.filter("properties", lambda p: p["stored"] & ~p["key"].startswith("_private:"))
        return scored.withColumn("properties", F.array_sort(visible)).drop("terms", "property_terms", "n_docs", *[c for c in scored.columns if c.startswith("df_")])

    def count(self, text: str | Query | Part, scope: str | None = None) -> int:
        return self.matches(text, scope).count()

    def snippets(self, hits: DataFrame, text: str | Query) -> DataFrame:
        """uri and snippet of hits that still have their text."""
        return hits.select("uri", snippets(F.col("text"), human.search_terms(self.query(text), self.analyzer.terms)).alias("snippet"))

    def with_property(self, kind: str, key: str, value: str) -> DataFrame:
        return self.matches(Property(kind, key, value)).select("uri")

    def term_frequencies(self) -> DataFrame:
        return rank.term_frequencies(match.analyzed(self.docs, self.analyzer))

    def fields(self) -> DataFrame:
        return self.docs.select(F.explode("properties").alias("p")).select(F.concat(F.lit("prop:"), "p.type", F.lit(":"), "p.key").alias("field")).distinct()

    def info(self) -> DataFrame:
        return self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")

    def added(self, docs: DataFrame) -> Engine:
        return Engine(changes.upserted(self.docs, docs), self.analyzer)

    def removed(self, uris: DataFrame) -> Engine:
        return Engine(changes.removed(self.docs, uris), self.analyzer)

    def merged(self, other: Engine) -> Engine:
        """Both engines' documents; this one's where both have a URI."""
        rest = other.docs.join(self.docs.select("uri"), "uri", "left_anti").select(*self.docs.columns)
        return Engine(self.docs.unionByName(rest), self.analyzer)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siftwell")
    parser.add_argument("path", help="the folder of an index")
    parser.add_argument("command", choices=["query", "count", "terms", "fields", "info", "build", "extract", "delete", "optimize", "merge", "sweep", "serve"])
    parser.add_argument("text", nargs="?", default="", help="a query; the files to build from or to extract; a URI to delete; an index to merge")
    parser.add_argument("--max-hits", type=int, default=100)
    parser.add_argument("--scope", choices=sorted(SCOPES))
    parser.add_argument("--source", default="Files")
    parser.add_argument("--port", type=int, default=4000)
    found = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    index = Index(spark, found.path, SIMPLE)
    if found.command == "build":
        index.update(registry.SOURCES[found.source].load(spark, found.text)) if index.segments() else index.add(registry.SOURCES[found.source].load(spark, found.text))
    elif found.command == "extract":
        files.read(spark, found.text).select("path", "file_type", "text", "properties", "error").show(found.max_hits, False)
    elif found.command == "delete":
        index.delete(spark.createDataFrame([(found.text,)], "uri string"))
    elif found.command == "optimize":
        index.optimize()
    elif found.command == "merge":
        index.add_index(Index(spark, found.text, SIMPLE))
    elif found.command == "sweep":
        print("\n".join(index.sweep()))
    elif found.command == "serve":
        from siftwell.service import Service, http_server

        http_server(Service(index), found.port).serve_forever()
    else:
        engine = Engine(index.documents())
        if found.command == "query":
            engine.search(found.text, found.max_hits, found.scope).select("uri", "ts", "score").show(found.max_hits, False)
        elif found.command == "count":
            print(engine.count(found.text, found.scope))
        else:
            {"terms": engine.term_frequencies, "fields": engine.fields, "info": engine.info}[found.command]().show(found.max_hits, False)


if __name__ == "__main__":
    main()

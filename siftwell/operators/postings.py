"""A stored inverted index for many queries over the same documents.

postings has a row for each occurrence, sorted by field and term within its files, so that a term's rows are
found by the files' statistics; queries are semi-, anti- and positional joins on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.analysis import Analyzer


def build(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """field, term, uri, pos of texts, and of text properties under prop:t:key."""
    texts = docs.select(F.lit("Text").alias("field"), "uri", F.posexplode(analyzer.column(F.col("text"))).alias("pos", "term"))
    own = docs.select("uri", F.explode(F.filter("properties", lambda p: (p["type"] == "t") & p["searched"])).alias("p"))
    own = own.select(F.concat(F.lit("prop:t:"), F.col("p.key")).alias("field"), "uri", F.posexplode(analyzer.column(F.col("p.value"))).alias("pos", "term"))
    return texts.unionByName(own).select("field", "term", "uri", "pos")


def write(postings: DataFrame, path: str, parts: int) -> None:
    postings.repartitionByRange(parts, "field", "term", "uri").sortWithinPartitions("field", "term", "uri", "pos").write.mode("overwrite").parquet(path)


def with_term(postings: DataFrame, word: str, field: str = "Text") -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == word)).select("uri").distinct()


def with_phrase(postings: DataFrame, words: list[str], field: str = "Text") -> DataFrame:
    """Joins on (uri, place less the word's number), the words' rows only."""
    own = postings.where(F.col("field") == field)
    rows = [own.where(F.col("term") == w).select("uri", (F.col("pos") - k).alias("start")) for k, w in enumerate(words)]
    return reduce(lambda a, b: a.join(b, ["uri", "start"], "left_semi"), rows).select("uri").distinct()


def with_all(sets: list[DataFrame], without: list[DataFrame] = []) -> DataFrame:  # noqa: B006
    found = reduce(lambda a, b: a.join(b, "uri", "left_semi"), sets)
    return reduce(lambda a, b: a.join(b, "uri", "left_anti"), without, found)


def with_pattern(postings: DataFrame, test: Column) -> DataFrame:
    return postings.where(test).select("uri").distinct()

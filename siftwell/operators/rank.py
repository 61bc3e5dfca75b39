"""Scores, orders, limits and what is counted around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.storage import written


def frequency(terms: Column, word: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == word))


def statistics(docs: DataFrame, words: list[str]) -> DataFrame:
    """One row: how many documents there are, and in how many each word is (df_0, df_1, ...)."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.array_contains("terms", w)).alias(f"df_{k}") for k, w in enumerate(words)])


def idf(n: Column, df: Column) -> Column:
    return F.log(n / (df + 1)) + 1


def scored(hits: DataFrame, docs: DataFrame, words: list[str]) -> DataFrame:
    """hits with the sum over words of sqrt(tf) * (ln(N / (df + 1)) + 1); a repeated word counts again.

    The statistics are one row from one pass over all documents, broadcast to the hits.
    """
    distinct = list(dict.fromkeys(words))
    total = F.lit(0.0)
    for w in words:
        total = total + F.sqrt(frequency(F.col("terms"), w)) * idf(F.col("n_docs"), F.col(f"df_{distinct.index(w)}"))
    return hits.join(F.broadcast(statistics(docs, distinct))).withColumn("score", total)


def classic(hits: DataFrame, docs: DataFrame, words: list[str]) -> DataFrame:
    """The vector-space score: tf, squared idf, length norm, query norm and the share of the words that are there."""
    distinct = list(dict.fromkeys(words))
    found = hits.join(F.broadcast(statistics(docs, distinct)))
    weights = [idf(F.col("n_docs"), F.col(f"df_{k}")) for k in range(len(distinct))]
    norm = F.lit(0.0)
    for w in weights:
        norm = norm + w * w
    total, there = F.lit(0.0), F.lit(0)
    for w, word in zip(weights, distinct):
        tf = frequency(F.col("terms"), word)
        total = total + F.sqrt(tf) * w * w
        there = there + F.when(tf > 0, 1).otherwise(0)
    return found.withColumn("score", total * (there / F.lit(len(distinct))) / F.sqrt(norm) / F.sqrt(F.greatest(F.size("terms"), F.lit(1))))


def best_of(scores: list[Column], tie: float = 0.0) -> Column:
    """The greatest score and a share of the others."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return top + (total - top) * tie


def recent(hits: DataFrame, most: int) -> DataFrame:
    """The latest hits; ties by URI."""
    return hits.orderBy(F.desc_nulls_last("ts"), "uri").limit(most)


def recent_per_source(hits: DataFrame, most: int, source: str = "source") -> DataFrame:
    """The latest hits of each source. A rank that is limited is cut in each task before rows are shuffled."""
    w = Window.partitionBy(source).orderBy(F.desc_nulls_last("ts"), "uri")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def order_of(by: str) -> list[Column]:
    """The keys of an order: relevance, name or modified; ties by the latest, then the URI."""
    keys = {"relevance": [F.desc("score")], "name": [F.lower("name")], "modified": []}[by]
    return [*keys, F.desc_nulls_last("ts"), F.col("uri")]


def in_order(hits: DataFrame, by: str) -> DataFrame:
    return hits.orderBy(*order_of(by))


def unique(hits: DataFrame, rank: str) -> DataFrame:
    """Of each URI the row of the best source: a partial aggregate, so a repeated URI isn't gathered."""
    rest = [c for c in hits.columns if c != "uri"]
    first = hits.groupBy("uri").agg(F.min_by(F.struct(*rest), F.col(rank)).alias("__row"))
    return first.select("uri", "__row.*")


def timeline(ts: Column, now: Column) -> Column:
    """The bucket that a time falls in; what is to come counts as today."""
    days = F.datediff(now, ts)
    return (
        F.when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, "this week")
        .when(days < 14, "last week")
        .when(days < 31, "this month")
        .when(F.year(ts) == F.year(now), "this year")
        .otherwise("older")
    )


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term, df and cf over all documents: a term's rows are first counted within a document, on the side that they are made."""
    within = docs.select("uri", F.explode("terms").alias("term")).groupBy("uri", "term").agg(F.count(F.lit(1)).alias("n"))
    return within.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def term_vector(docs: DataFrame) -> DataFrame:
    """uri, term, tf and the first and last place of each term of each document."""
    return docs.select("uri", F.posexplode("terms").alias("pos", "term")).groupBy("uri", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with the place of each row in an order, from zero; no task numbers all rows, as places come from the counts
    of the order's ranges."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(spread.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "numbered")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    # A row for each range; there are as many as shuffle partitions.
    before = sizes.select("__part", "__first", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__id") - F.col("__first")
    return parts.join(F.broadcast(before), "__part").withColumn(name, place).drop("__part", "__id", "__first", "__before")


def batches(hits: DataFrame, size: int = 25) -> DataFrame:
    """Hits with the number of the message that each goes out in, the latest first."""
    return numbered(hits, F.desc_nulls_last("ts"), F.col("uri"), name="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def sliced(hits: DataFrame, start: int, limit: int, *order: Column | str) -> DataFrame:
    """Rows start to start + limit of an order."""
    return hits.orderBy(*order).offset(start).limit(limit)


def block_sample(docs: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Documents of a share of the blocks of 1,024 row numbers (of the URIs' hashes), whole blocks at a time."""
    block = F.shiftright(F.xxhash64("uri"), 10)
    return docs.where(F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def event_rate(events: DataFrame, ts: str, window: str = "1 hour") -> DataFrame:
    """start, n and per_second of each window of time."""
    found = events.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return found.select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def source_status(docs: DataFrame) -> DataFrame:
    """source, items, the latest time, and whether it has any text, of each source."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.max("ts").alias("latest"), F.max(F.col("text").isNotNull()).alias("has_text"))


def matches_and_returned(hits: DataFrame, most: int, source: str = "source") -> DataFrame:
    """How many hits each source has, and how many of them are given."""
    return hits.groupBy(source).agg(F.count(F.lit(1)).alias("matches")).withColumn("returned", F.least("matches", F.lit(most).cast("long")))


def explained(hits: DataFrame, docs: DataFrame, words: list[str]) -> DataFrame:
    """scored() hits with an explanation: for each word its frequency, idf and share, whether it matches, and the sum."""
    found = scored(hits, docs, words)
    distinct = list(dict.fromkeys(words))
    parts = []
    for w in words:
        tf, weight = frequency(F.col("terms"), w), idf(F.col("n_docs"), F.col(f"df_{distinct.index(w)}"))
        parts.append(F.struct(F.lit(w).alias("word"), (tf > 0).alias("match"), tf.alias("freq"), F.sqrt(tf).alias("tf"), weight.alias("idf"), (F.sqrt(tf) * weight).alias("value")))
    return found.withColumn("explanation", F.struct(F.col("score").alias("value"), F.lit("sum of").alias("description"), F.array(*parts).alias("details")))


def boosted(scores: list[tuple[Column, float]], coordinated: bool = True) -> Column:
    """The sum of clauses' scores times their boosts, times the share of clauses that have one if coordinated; with a score of
    null for a clause that doesn't match, an optional clause only adds."""
    total, there = F.lit(0.0), F.lit(0)
    for score, boost in scores:
        total = total + F.coalesce(score * boost, F.lit(0.0))
        there = there + F.when(score > 0, 1).otherwise(0)
    return total * there / len(scores) if coordinated else total

"""MinHash near-dedup by min-max hashing.

Under each of PERMUTATIONS hash permutations a document keeps both the least and the greatest value
of its shingles, so half the hash evaluations give a signature of twice the length whose estimate has
the lower variance of the two-sided sketch. Bands of BAND_ROWS values make the candidate buckets.

Exact copies fold into one class first. Of a bucket's classes only a star of pairs around its most
central class is compared at first; after that, only pairs whose ends are still in different
components. A pair is linked when the Jaccard similarity of the full shingle sets is at least
LINK_PERCENT / 100. No cap is put on buckets, pairs or components.

Hostile cases: a null or blank text has no shingles and links with nothing; fewer than SHINGLE words
make one shingle of the whole sequence; rows with equal ids or null ids are rows of their own (the
component's id is the least id that isn't null, and null if there is none); an empty table gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bloom
from siftwell.llm.shared import counted, even_join, forget, slices, small_batches, written

SHINGLE = 5
LINK_PERCENT = 75
PERMUTATIONS = 100
#: Two classes at a similarity of exactly 0.75 have no band in common with a chance of 6 in a billion.
BAND_ROWS = 4
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: From this many classes in a bucket on, classes that can't reach the similarity with any other are left out.
CROWDED = 3
#: Shingles hashed at a time, so that the work stays in the cache.
CHUNK = 1 << 15
KNOWN_WORDS = 200_000
#: Classes that a task remembers having given the set of.
KNOWN_CLASSES = 200_000
#: Up to so many short rows of removed documents are broadcast (16 MB at most); beyond, they are joined.
BROADCAST_ROWS = 200_000
#: Shingles in a block of a component's members.
BLOCK_SHINGLES = 1 << 14

PROFILE = "doc_id long, text_hash long, n_shingles long, class binary, bands array<long>"
SETS = "class binary, n long, shingles array<long>"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)
_known: dict[str, int] = {}


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def _mix(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts) * int(_M2) % 2**64, np.uint64)
    for p in parts:
        h = (h ^ p) * _M1
        h ^= h >> _S
        h *= _M2
    return h ^ (h >> _S)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text, its distinct shingle hashes in order."""
    # Lower case first: of a part of a batch a cast array's places begin behind zero, which ascii_lower() gets wrong.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    code = flat.dictionary_encode()
    h = _word_hashes(code.dictionary.to_pylist())[code.indices.to_numpy(zero_copy_only=False)][full] if len(flat) else np.empty(0, np.uint64)
    doc = doc[full]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = _mix([h[k : len(h) - SHINGLE + 1 + k] for k in range(SHINGLE)]) if len(h) >= SHINGLE else h[:0]
    found = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            found.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            found.append(_mix([h[i : i + 1] for i in range(a, b)]))
        else:
            found.append(h[:0])
    return found


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS hashes for each set; all sets must have members."""
    sign = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    factors = _multipliers()
    sizes = [len(s) for s in sets]
    for a, b in slices(sizes, CHUNK):
        h = np.concatenate(sets[a:b])
        at = np.concatenate(([0], np.cumsum(sizes[a:b])[:-1]))
        for k, factor in enumerate(factors):
            v = h * factor
            sign[k, a:b] = np.minimum.reduceat(v, at)
            sign[PERMUTATIONS + k, a:b] = np.maximum.reduceat(v, at)
    out = np.empty((len(sets), BANDS), np.uint64)
    step = PERMUTATIONS // BAND_ROWS
    for j in range(BANDS):  # the values of a band, least and greatest by turns, come from different permutations
        rows = [(j + step * k) % PERMUTATIONS + PERMUTATIONS * (k % 2) for k in range(BAND_ROWS)]
        out[:, j] = _mix([np.full(len(sets), j, np.uint64), *(sign[r] for r in rows)])
    return out


def _class(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for a, b in slices(sizes):
        part = batch.slice(a, b - a)
        yield part, shingle_sets(part.column("text"))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sets in _texts(batch):
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list[np.ndarray | None] = [None] * len(sets)
            if some:
                for i, row in zip(some, band_hashes([sets[i] for i in some]).view(np.int64)):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "class", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[bytes] = set()
    for batch in batches:
        for _, sets in _texts(batch):
            rows = []
            for s in sets:
                c = _class(s)
                if c and c not in met:  # of copies in a task one is enough
                    rows.append((c, len(s), s.view(np.int64)))
                    if len(met) < KNOWN_CLASSES:
                        met.add(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                ["class", "n", "shingles"],
            )


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (of equal sets; null if empty) and bands of each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(_profile, PROFILE)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; pairs is written. A hub's many pairs are dealt out."""
    n, both = pairs.count(), pairs
    for x in "ab":
        own = sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
        both = even_join(both, own, x, counted(pairs, x), n)
    both = both.withColumn("inter", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("inter") * 100 >= (F.col("na") + F.col("nb") - F.col("inter")) * LINK_PERCENT).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each node of links (a, b) reaches.

    Roots fall by neighbours' roots and by roots of roots until nothing changes; the tables of each
    round are written, so a lost executor costs a round at most. Nodes of many links, and roots of many
    nodes, are dealt out.
    """
    links = links.where(F.col("a") != F.col("b"))
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    n_links, degrees = both.count(), counted(both, "b")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    n_nodes = roots.count()
    while True:
        near = even_join(both, roots.select(F.col("node").alias("b"), "root"), "b", degrees, n_links).groupBy("a").agg(F.min("root").alias("low"))
        lower = written(roots.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("was"), F.least("root", "low").alias("via")), "lower")
        up = lower.select(F.col("node").alias("via"), F.col("via").alias("top"))
        many = counted(lower, "via")
        nxt = written(even_join(lower, up, "via", many, n_nodes, "left").select("node", "was", F.least("via", "top").alias("root")), "roots")
        moved = nxt.where(F.col("was") != F.col("root")).limit(1).count()
        forget(roots, lower, many)
        roots = nxt
        if not moved:
            break
    forget(both, degrees)
    out = roots.select("node", "root")
    out.written_path = roots.written_path
    return out


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(buckets, crowds, n): bucket, class, n, crowd and least_n of all buckets with two classes or more, how many
    classes each has (n_rows), and how many rows there are."""
    members = classes.select(F.explode("bands").alias("bucket"), "class", "n")
    crowds = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("least_n")).where("n_rows > 1"), "crowds")
    n = crowds.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    found = even_join(members, crowds.withColumn("crowd", F.col("n_rows")).drop("n_rows"), "bucket", crowds.select("bucket", "n_rows"), n)
    return written(found, "buckets"), crowds.select("bucket", "n_rows"), n


def _rare(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """class, shared and rare: how many of a class's shingles another class of a crowded bucket also has,
    and the rarest of these. Of its shingles ordered by rarity, rare has those among the first
    n - ceil(LINK_PERCENT % of n) + 1: two similar enough sets have one of these in common."""
    rows = written(sets.join(crowded.select("class").distinct(), "class", "left_semi").select("class", "n", F.explode("shingles").alias("shingle")), "shingles")
    more = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "repeated")
    found = even_join(rows, more, "shingle", more.select("shingle", F.col("df").alias("n_rows")), rows.count()).groupBy("class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    single = F.col("n") - F.size("rare")
    first = F.col("n") - F.ceil(F.col("n") * LINK_PERCENT / 100) + 1
    out = written(found.select("class", F.size("rare").alias("shared"), F.slice("rare", 1, F.greatest(first - single, F.lit(0)).cast("int")).alias("rare")), "rare")
    forget(rows, more)
    return out


def _between(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) from the loose of rest (class, n, root, loose, rare) to other components.

    The members of a component make blocks of about BLOCK_SHINGLES; a loose class meets each block once
    that has one of its rare shingles, and only links come out of that.
    """
    sizes = written(rest.groupBy("root").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_rows")), "sizes")
    many = sizes.select("root", "n_rows")
    block = F.concat_ws("-", F.hex("root"), F.pmod(F.xxhash64("class"), F.ceil(F.col("total") / BLOCK_SHINGLES)))
    blocked = written(even_join(rest, sizes.select("root", "total"), "root", many, rest.count()).select("class", "n", "root", "loose", "rare", block.alias("block")), "blocked")
    there = blocked.select("root", "block", F.explode("rare").alias("shingle")).distinct()
    loose = blocked.where("loose").select(F.col("class").alias("a"), F.col("root").alias("root_a"), F.explode("rare").alias("shingle"))
    meets = written(loose.join(there, "shingle").where(F.col("root") != F.col("root_a")).select("a", "block").distinct(), "meets")
    blocks = blocked.select("class", "block").join(meets.select("block").distinct(), "block", "left_semi").join(sets, "class")
    blocks = blocks.groupBy("block").agg(F.collect_list(F.struct("class", "n", "shingles")).alias("members"))
    ends = meets.join(sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    ends = even_join(ends, blocks, "block", counted(meets, "block"), meets.count())

    def linked(y):
        inter = F.size(F.array_intersect(F.col("sa"), y["shingles"]))
        near = F.least(F.col("na"), y["n"]) * 100 >= F.greatest(F.col("na"), y["n"]) * LINK_PERCENT
        return near & (inter * 100 >= (F.col("na") + y["n"] - inter) * LINK_PERCENT)

    found = ends.select("a", F.transform(F.filter("members", linked), lambda y: y["class"]).alias("bs"))
    return found.where(F.size("bs") > 0).select("a", F.explode("bs").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_classes(docs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, roots): classes of equal sets with first_doc, and the component root of the linked ones."""
    classes = written(
        profiles.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n_rows")), "classes"
    )
    buckets, crowds, n_members = _buckets(classes)
    wanted = written(classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "text_hash"), "wanted")
    blocks = bloom.blocks_for(wanted.count())
    blooms = bloom.build(wanted, "text_hash", blocks)
    texts = bloom.probe(docs.select(F.col("text").cast("string").alias("text")), F.xxhash64("text"), blooms, "maybe", blocks).where("maybe").select("text")
    sets = written(texts.mapInArrow(_full_sets, SETS).join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "sets")
    forget(wanted)

    # Where many meet, a class with too few shared shingles can't be linked with any of them: with s of its n
    # shingles found elsewhere and no other set of under m, its similarity is at most s / (n + m - s).
    crowded = buckets.where(F.col("crowd") >= CROWDED)
    rare = _rare(crowded, sets)
    s, n = F.coalesce(F.col("shared"), F.lit(0)), F.col("n")
    able = s * 100 >= (n + F.greatest(F.col("least_n"), s) - s) * LINK_PERCENT
    apt = buckets.join(rare.select("class", "shared"), "class", "left").where((F.col("crowd") < CROWDED) | able)
    apt = written(apt.select("bucket", "class", "n", "crowd", "least_n", (s / n).alias("central")), "apt")

    hubs = written(apt.groupBy("bucket").agg(F.max(F.struct("central", "class", "n")).alias("hub")).select("bucket", F.col("hub.class").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")

    def similar_size(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * LINK_PERCENT

    stars = even_join(apt, hubs, "bucket", crowds, n_members).where((F.col("hub") != F.col("class")) & similar_size("n", "hub_n"))
    stars = written(stars.select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct(), "pairs")
    links = written(_confirmed(stars, sets), "stars")
    roots = components(links)

    # What the stars left apart: of a bucket whose members are in several components, those outside its hub's
    # component are compared with all that share a rare shingle. Sets of n and m with similarity t have at
    # least t / (1 + t) * (n + m) shingles in common, so all but so many, less one, of the rarest decide.
    # In a bucket of two the star has left nothing.
    placed = apt.where(F.col("crowd") >= CROWDED).join(roots, F.col("class") == F.col("node"), "left").select("bucket", "class", "n", "least_n", F.coalesce("root", "class").alias("root"))
    placed = written(placed, "placed")
    parts = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    hub_root = hubs.join(parts, "bucket").join(roots, F.col("hub") == F.col("node"), "left").select("bucket", F.coalesce("root", "hub").alias("hub_root"))
    hub_root = written(hub_root, "hub_roots")
    rest = even_join(placed, hub_root, "bucket", crowds, n_members).groupBy("class").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("least_n").alias("least_n"), F.max(F.col("root") != F.col("hub_root")).alias("loose"))
    least_m = F.greatest("least_n", F.ceil(F.col("n") * LINK_PERCENT / 100))
    first = F.col("n") - F.ceil((F.col("n") + least_m) * LINK_PERCENT / (100 + LINK_PERCENT)) + 1
    rest = rest.join(rare, "class").withColumn("first", F.greatest(first - (F.col("n") - F.col("shared")), F.lit(0)).cast("int"))
    rest = written(rest.select("class", "n", "root", "loose", F.slice("rare", 1, F.col("first"))["shingle"].alias("rare")), "rest")
    more = written(_between(rest, sets), "more")
    if more.limit(1).count():
        forget(roots)
        roots = components(links.union(more))
    forget(buckets, sets, rare, apt, hubs, stars, links, placed, hub_root, rest, more)
    return classes, roots


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    profiles = written(profile(docs), "profiles")
    classes, roots = link_classes(docs, profiles)
    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "first_doc", "n_rows", F.coalesce("root", "class").alias("root"))
    rooted = written(rooted, "rooted")
    lows = written(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n_rows")), "lows")
    of_class = even_join(rooted, lows.select("root", "component_id"), "root", lows.select("root", "n_rows"), rooted.count())
    of_class = written(of_class.select("class", "component_id", "n_rows"), "of_class")
    some = profiles.where(F.col("class").isNotNull()).select("doc_id", "text_hash", "n_shingles", "class")
    out = even_join(some, of_class.select("class", "component_id"), "class", of_class.select("class", "n_rows"), profiles.count()).drop("class")
    empty = profiles.where(F.col("class").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    forget(classes, roots, rooted, lows)
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    return _placed(docs).drop("text_hash")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are: of each component the document with the least id.

    Rows that share both id and text are one document and stay or go together.
    """
    gone = written(_placed(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")


def _sql_words(alias: str) -> str:
    return f"regexp_extract_all(translate({alias}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_sql_words("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {LINK_PERCENT} * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.a = w.doc_id
"""

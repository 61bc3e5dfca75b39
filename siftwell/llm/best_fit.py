"""Best-fit packing into bins of several capacities.

Texts longer than the largest capacity are cut into pieces. Pieces are dealt by a hash of their
id into shards of about SHARD_PIECES, as many as the input needs, and each shard is packed by itself:
longest first, a piece goes into the open bin that it leaves the least room in. Where none has room, a
bin is opened whose capacity costs least a token: each capacity is filled on trial with the longest
remaining pieces that fit, and its cost is shared by what that packs. At last each bin becomes the
smallest capacity that holds its contents.

Lengths are of byte-level tokens, so a piece may end within a letter of several bytes.

Hostile cases: a null or empty text has length 0 and makes no piece; rows with equal or null ids are
rows of their own; ties are broken by id and place, so results don't depend on how rows are dealt; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import small_batches, written

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: What a bin costs besides its capacity, in tokens: a sequence's fixed share of a step.
BIN_COST = 64
#: Attention makes longer sequences dearer: a token of a bin of this length costs twice one of a short bin.
DOUBLE_AT = 65536
SHARD_PIECES = 2048
#: Equal pieces that a task makes of one row.
TOGETHER = 4096

PACKED = "doc_id long, piece long, start long, length long, bin string, capacity long, offset long"


def bin_cost(capacity: int) -> float:
    return BIN_COST + capacity * (1 + capacity / DOUBLE_AT)


class _Rooms:
    """Open bins by the room they have left."""

    def __init__(self) -> None:
        self.rooms: list[tuple[int, int]] = []

    def best(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of size or more; of equals, the first opened."""
        at = bisect_left(self.rooms, (size, -1))
        return self.rooms.pop(at) if at < len(self.rooms) else None

    def put(self, room: int, number: int) -> None:
        if room:
            insort(self.rooms, (room, number))


def _trial(at: int, room: int, falling: list[int], sums: list[int]) -> int:
    """How much of a room the pieces from a place on fill, longest first; falling: sizes below zero, sums: of those before."""
    filled = 0
    while (at := bisect_left(falling, filled - room, at)) < len(falling):
        # A run of pieces that all fit; each run takes at least half of the room, so there are few.
        end = bisect_right(sums, sums[at] + room - filled, at) - 1
        filled += sums[end] - sums[at]
        at = end
    return filled


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, its capacity, offset) of each piece; sizes must not exceed the largest capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    capacities = tuple(sorted(capacities))
    falling, rooms = [-sizes[i] for i in order], _Rooms()
    sums = [0, *accumulate(sizes[i] for i in order)]
    filled: list[int] = []
    where: list[tuple[int, int]] = [(0, 0)] * len(sizes)

    def share(c: int, at: int) -> tuple[float, int]:
        """What a token costs in a bin of capacity c that the piece at a place opens; the bin is downsized at last."""
        holds = _trial(at, c, falling, sums)
        return bin_cost(capacities[bisect_left(capacities, holds)]) / holds, c

    for at, i in enumerate(order):
        size = sizes[i]
        found = rooms.best(size)
        if found is None:
            found = (min(share(c, at) for c in capacities[bisect_left(capacities, size) :])[1], len(filled))
            filled.append(0)
        room, number = found
        where[i] = (number, filled[number])
        filled[number] += size
        rooms.put(room - size, number)
    final = [capacities[bisect_left(capacities, f)] for f in filled]
    return [(number, final[number], offset) for number, offset in where]


def pieces(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """doc_id, row (tells rows of equal ids apart where their texts differ), piece, start and length."""
    most = max(capacities)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), F.xxhash64("text").alias("row")).where("n > 0")
    df = df.select("doc_id", "row", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("piece", "start"))
    return df.select("doc_id", "row", F.col("piece").cast("long").alias("piece"), "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("length"))


def _shard(capacities: tuple[int, ...]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        placed = pack(table.column("length").to_pylist(), capacities)
        shard = table.column("shard")[0].as_py()
        columns = {c: table.column(c) for c in ("doc_id", "piece", "start", "length")}
        columns["bin"] = pa.array([f"{shard}-{b}" for b, _, _ in placed], pa.string())
        columns["capacity"] = pa.array([c for _, c, _ in placed], pa.int64())
        columns["offset"] = pa.array([o for _, _, o in placed], pa.int64())
        return pa.table(columns)

    return run


def pack_documents(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """A row for each piece with its bin, the bin's capacity and its offset in it.

    length: tokens of a row; the bytes of its text, as byte-level models count them, if not given.
    """
    small_batches(docs.sparkSession)
    key = ("doc_id", "row", "piece", "start", "length")
    cut = pieces(docs, F.octet_length(F.col("text").cast("string")) if length is None else length, capacities)
    # Ids may repeat in any number: a piece's hash, and its number among equal pieces, deal it.
    copies = written(cut.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "pieces")
    shards = max(1, -(-(copies.agg(F.sum("copies").alias("n")).first()["n"] or 0) // SHARD_PIECES))
    # In two steps, so that no task makes all copies of one piece.
    lots = copies.select(*key, "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(TOGETHER).cast("long"))).alias("first"))
    some = lots.where(F.col("copies") <= TOGETHER).unionByName(lots.where(F.col("copies") > TOGETHER).repartition(*key, "first"))
    dealt = some.select(*key, F.explode(F.sequence("first", F.least("copies", F.col("first") + (TOGETHER - 1)))).alias("copy"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece", "copy"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_shard(capacities), PACKED)

"""A blocked Bloom filter as a table: a row for each block of 256 bits.

A key sets one bit in each of a block's four 64-bit lanes, so that a probe looks at one row. The
filter has about 16 bits for each of the counted keys. Up to BROADCAST_BLOCKS blocks it is broadcast; a larger one
is joined by block, the rows of a block that many rows meet dealt out. What few rows pass wrongly the exact
step behind it removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import counted, even_join, written

#: 2^19 blocks of 256 bits: 16 MB of bits, some 40 MB as a broadcast table, for 8 million keys.
BROADCAST_BLOCKS = 1 << 19
LEAST_BLOCKS, MOST_BLOCKS = 1 << 8, 1 << 30
LANES = ("lane_0", "lane_1", "lane_2", "lane_3")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """For each lane, the one bit that the key sets."""
    h = F.xxhash64(key, F.lit(29))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i + 3).bitwiseAND(F.lit(63)).cast("int")) for i in range(len(LANES))]


def blocks_for(n: int) -> int:
    """How many blocks n keys need: 16 keys have one."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (max(1, n) // 16).bit_length()))


def build(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter of a column's values (nulls are no members)."""
    key = F.col(column)
    bits = keys.where(key.isNotNull()).select(_block(key, blocks).alias("bloom_block"), *[b.alias(n) for b, n in zip(_bits(key), LANES)])
    return bits.groupBy("bloom_block").agg(*[F.bit_or(n).alias(n) for n in LANES])


def probe(df: DataFrame, key: Column, blooms: DataFrame, flag: str, blocks: int, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """df with a boolean column: false only where the key surely isn't a member (a null key isn't)."""
    at, names = f"__{flag}_at", {n: f"__{flag}_{n}" for n in LANES}
    table = blooms.select(F.col("bloom_block").alias(at), *[F.col(n).alias(m) for n, m in names.items()])
    df = df.withColumn(at, _block(key, blocks))
    if blocks <= most:
        found = df.join(F.broadcast(table), at, "left")
    else:
        df = written(df, "probed")
        found = even_join(df, table, at, counted(df, at), df.count(), "left")
    hit = key.isNotNull()
    for bit, lane in zip(_bits(key), LANES):
        hit = hit & (F.col(names[lane]).bitwiseAND(bit) != 0)
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(at, *names.values())

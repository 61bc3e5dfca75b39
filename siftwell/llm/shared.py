"""What the operators of this subpackage share: joins that deal out hot keys, columns and small helpers; written tables are the engine's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.shipping import ship
from siftwell.storage import forget, shared_dir, written

#: Rows and bytes that an Arrow batch may hold; texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A key that more than one in so many rows have is hot, so there are fewer hot keys than this.
HOT_SHARE = 4096
#: Rows that a key may have without being hot, however few rows there are.
HOT_LEAST = 512
#: Bytes of text that one vectorised step works on at a time.
SLICE_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words by ASCII white space, and what parts them.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Before a Python stage: keep Arrow batches small, as a few texts can be very long, and send this
    package to executors that don't have it installed. Smaller batches that are set already stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    ship(spark)


def even_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows joined with table by key, the rows of a hot key dealt to several copies of its rows in table.

    counts (key, n_rows): how many of the n rows have a key; keys that aren't hot may be missing. At most
    HOT_SHARE short rows of hot keys are broadcast, and as many rows of table copied again.
    """
    most = max(HOT_LEAST, n // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n_rows") > most).select(key, F.ceil(F.col("n_rows") / most).cast("int").alias("__deals")))
    deals = F.coalesce("__deals", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("__deal", F.pmod(F.monotonically_increasing_id(), deals).cast("int")).drop("__deals")
    table = table.join(hot, key, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("__deals")
    return rows.join(table, [key, "__deal"], how).drop("__deal")


def counted(rows: DataFrame, key: str) -> DataFrame:
    """The written counts for even_join() of the keys that can be hot."""
    return written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > HOT_LEAST), "hot")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slices(sizes, most: int = SLICE_BYTES):
    """(start, end) of runs of rows whose sizes sum to about most; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


__all__ = ["ascii_lower", "counted", "even_join", "forget", "sha256_hex", "shared_dir", "slices", "small_batches", "words_of", "written"]

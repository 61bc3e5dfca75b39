"""Live queries: results change as documents do, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltas(results: DataFrame, batch: DataFrame, matching: Callable[[DataFrame], DataFrame], removed: DataFrame | None = None) -> DataFrame:
    """op (-, then +) and uri of what a batch of added documents does to a query's results.

    Every added URI that is among the results is subtracted first; those that match are added. Removed URIs
    are subtracted if they are among the results.
    """
    touched = batch.select("uri")
    if removed is not None:
        touched = touched.union(removed.select("uri"))
    minus = results.select("uri").join(touched.distinct(), "uri", "left_semi").select(F.lit(0).alias("step"), F.lit("-").alias("op"), "uri")
    plus = matching(batch).select("uri").distinct().select(F.lit(1).alias("step"), F.lit("+").alias("op"), "uri")
    return minus.unionByName(plus)


def applied(results: DataFrame, changes: DataFrame) -> DataFrame:
    """The results after deltas."""
    gone = changes.where(F.col("op") == "-").select("uri")
    return results.select("uri").join(gone, "uri", "left_anti").union(changes.where(F.col("op") == "+").select("uri")).distinct()


def listen(stream: DataFrame, matching: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], results: Callable[[], DataFrame], checkpoint: str):
    """Start a live query over a stream of documents; sink gets each batch's deltas.

    Results are read through a function, as the sink changes them. A batch that is repeated after a failure
    gives the same deltas as long as sink writes them under the batch's number.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(deltas(results(), batch, matching), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

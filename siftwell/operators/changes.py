"""A change feed into documents: coalescing, upserts, removals with children, and property changes.

changes: seq, op (add, remove, property), uri, parent_uri, and properties as an array of (key, value) structs.
State is a table of documents (uri, parent_uri, properties) and one of mutable properties (uri, key, value, persistent).
All is expressed as joins on uri, so a batch touches the state once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.shipping import ship


def coalesced(changes: DataFrame) -> DataFrame:
    """Of each URI the last add or remove, and the property changes after it that still count.

    Property changes after a removal are dropped; later values of a key replace earlier ones.
    """
    last = changes.where(F.col("op") != "property").groupBy("uri").agg(F.max_by(F.struct("seq", "op", "parent_uri"), "seq").alias("last"))
    later = changes.where(F.col("op") == "property").join(last, "uri", "left").where(F.col("last").isNull() | ((F.col("seq") > F.col("last.seq")) & (F.col("last.op") != "remove")))
    keys = later.select("uri", "seq", F.explode("properties").alias("p")).groupBy("uri", F.col("p.key").alias("key")).agg(F.max_by("p.value", "seq").alias("value"))
    keys = keys.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("properties"))
    out = last.join(keys, "uri", "full")
    return out.select("uri", F.coalesce("last.op", F.lit("property")).alias("op"), F.col("last.parent_uri").alias("parent_uri"), F.coalesce("properties", F.array().cast("array<struct<key:string,value:string>>")).alias("properties"))


def removed(documents: DataFrame, uris: DataFrame) -> DataFrame:
    """Documents without those of uris and their children, one level down."""
    gone = uris.select(F.col("uri").alias("__gone"))
    left = documents.join(gone, F.col("uri") == F.col("__gone"), "left_anti")
    return left.join(gone, F.col("parent_uri") == F.col("__gone"), "left_anti")


def upserted(documents: DataFrame, adds: DataFrame) -> DataFrame:
    """Documents with adds in place of what had their URIs or was a child of these."""
    return removed(documents, adds.select("uri")).unionByName(adds.select(*documents.columns))


def carried(mutable: DataFrame, adds: DataFrame) -> DataFrame:
    """Mutable properties after adds (uri, key, value, persistent): those of an added URI are replaced,

    but its persistent ones stay unless they are given anew, and all stay if none is given.
    """
    uris = adds.select("uri").distinct()
    given = adds.where(F.col("key").isNotNull())
    old = mutable.join(uris, "uri", "left_semi").join(given.select("uri").distinct().withColumn("__any", F.lit(True)), "uri", "left")
    kept = old.where(F.col("__any").isNull() | F.col("persistent")).drop("__any").join(given.select("uri", "key"), ["uri", "key"], "left_anti")
    return mutable.join(uris, "uri", "left_anti").unionByName(kept).unionByName(given.select(*mutable.columns))


def changed(mutable: DataFrame, changes: DataFrame) -> DataFrame:
    """Mutable properties after changes (seq, uri, key, value): of a key's changes the last holds, an empty value takes the
    key away, and a key that was persistent stays so. Without seq, a key must come once."""
    order = F.col("seq") if "seq" in changes.columns else F.lit(0)
    last = changes.groupBy("uri", "key").agg(F.max_by(F.struct("value"), order).alias("v")).select("uri", "key", "v.value")
    rest = mutable.join(last.select("uri", "key"), ["uri", "key"], "left_anti")
    old = mutable.groupBy("uri", "key").agg(F.max("persistent").alias("persistent"))
    new = last.where(F.col("value").isNotNull() & (F.col("value") != "")).join(old, ["uri", "key"], "left")
    return rest.unionByName(new.withColumn("persistent", F.coalesce("persistent", F.lit(False))).select(*mutable.columns))


def removed_by_property(documents: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    """Documents without those that have a property, and without their children."""
    uris = documents.where(F.exists("properties", lambda p: (p["type"] == kind) & (p["key"] == key) & (p["value"] == value))).select("uri")
    return removed(documents, uris)


def changed_children(children: DataFrame, parents: DataFrame, changes: DataFrame) -> DataFrame:
    """uri, key, value that children have from their parents after changes (uri, key, value) of these.

    parents: uri, key, value. Only children of changed parents are given.
    """
    mutable = parents.select("uri", "key", "value").withColumn("persistent", F.lit(False))
    after = changed(mutable, changes).join(changes.select("uri").distinct(), "uri", "left_semi")
    return child_properties(children.join(changes.select(F.col("uri").alias("parent_uri")).distinct(), "parent_uri", "left_semi"), after)


def overwritten(properties: DataFrame) -> DataFrame:
    """Properties (uri, seq, key, value, mutable) of which a mutable one takes the place of the one before; others add up."""
    once = properties.where("mutable").groupBy("uri", "key").agg(F.max_by(F.struct("seq", "value"), "seq").alias("x"))
    once = once.select("uri", "x.seq", "key", "x.value", F.lit(True).alias("mutable"))
    return properties.where(~F.col("mutable")).select("uri", "seq", "key", "value", "mutable").unionByName(once)


def child_properties(children: DataFrame, parents: DataFrame) -> DataFrame:
    """uri, key, value that children get from their parents: keys behind parent:, without private ones.

    parents: uri, key, value.
    """
    own = parents.where(~F.col("key").startswith("_private:") & ~F.col("key").startswith("parent:"))
    own = own.select(F.col("uri").alias("parent_uri"), F.concat(F.lit("parent:"), "key").alias("key"), "value")
    return children.select("uri", "parent_uri").join(own, "parent_uri").select("uri", "key", "value")


def sessions(lines: DataFrame, group: str, most_lines: int = 50, most_minutes: int = 360) -> DataFrame:
    """group, ts, line and session (its day and number in it) of the lines (group, ts, line) of logs.

    A session ends with its day, and with the first line that comes when it has more than most_lines lines and is
    older than most_minutes. A log's first session begins with the hour of its first line. A day of a log
    is sorted by its tasks and read batch by batch, in order, so that a busy one is never in memory as a whole.
    """
    df = lines.select(F.col(group).cast("string").alias("group"), "ts", F.col("line").cast("long").alias("line"), F.to_date("ts").cast("string").alias("day"))
    first = df.groupBy("group").agg(F.min("day").alias("first_day"))
    # Logs may be few, so these short rows are joined by the optimiser's choice.
    df = df.join(first, "group").where(F.col("ts").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begin, n, number = None, None, 0, 1
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("group", "day", "first_day", "ts")))
            for name, day, first_day, ts in rows:
                if (name, day) != at:
                    at, n, number = (name, day), 0, 1
                    begin = ts.replace(minute=0, second=0, microsecond=0) if day == first_day else ts
                elif n > most_lines and (ts - begin).total_seconds() > most_minutes * 60:
                    begin, n, number = ts, 0, number + 1
                n += 1
                out.append(f"{day}/{number}")
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("ts"), batch.column("line"), pa.array(out, pa.string())], ["group", "ts", "line", "session"])

    ship(lines.sparkSession)
    dealt = df.repartition("group", "day").sortWithinPartitions("group", "day", "ts", "line")
    return dealt.mapInArrow(cut, "group string, ts timestamp, line long, session string")

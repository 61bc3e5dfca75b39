"""Sources by name: each has a domain, the kind of its hits, and the files that it reads.

A loader gives documents (uri, parent_uri, ts, source, domain, hit_type, mime_type, file_type, text,
properties) of a folder. More are registered with register().
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.scalar import fuzzy_divide
from siftwell.operators.match import prop, properties
from siftwell.plans.parts import GLOBAL, LOCAL, NEIGHBORHOOD, SYSTEM
from siftwell.sources import files
from siftwell.storage import written

Loader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    domain: int
    hit_type: str
    pattern: str = "*"
    mime_type: str | None = None

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return of_files(spark, path, self)


# What desktop programs keep, as files of known forms.
SOURCES = {
    s.name: s
    for s in (
        Source("Akregator", LOCAL, "FeedItem", "*.xml", "application/rss+xml"),
        Source("Blam", LOCAL, "FeedItem", "*.xml", "application/rss+xml"),
        Source("Empathy", LOCAL, "IMLog", "*.log", "siftwell/x-empathy-log"),
        Source("EvolutionDataServer", LOCAL, "Contact", "*.vcf", "text/x-vcard"),
        Source("EvolutionMail", LOCAL, "MailMessage", "*", "message/rfc822"),
        Source("Files", LOCAL | NEIGHBORHOOD, "File"),
        Source("GMailSearch", GLOBAL, "MailMessage", "*.eml", "message/rfc822"),
        Source("IndexingService", LOCAL, "File"),
        Source("KAddressBook", LOCAL, "Contact", "*.vcf", "text/x-vcard"),
        Source("KMail", LOCAL, "MailMessage", "*", "message/rfc822"),
        Source("KNotes", LOCAL, "Note", "*.ics", "text/calendar"),
        Source("KOrganizer", LOCAL, "Calendar", "*.ics", "text/calendar"),
        Source("KonqBookmark", LOCAL, "Bookmark", "*.xml", "text/xml"),
        Source("KonquerorHistory", LOCAL, "WebHistory", "*", "siftwell/x-konq-history"),
        Source("Konversation", LOCAL, "IMLog", "*.log", "siftwell/x-konversation-log"),
        Source("Kopete", LOCAL, "IMLog", "*.xml", "siftwell/x-kopete-log"),
        Source("Labyrinth", LOCAL, "Note", "*.map", "siftwell/x-labyrinth-map"),
        Source("Liferea", LOCAL, "FeedItem", "*", "application/rss+xml"),
        Source("Locate", SYSTEM, "File"),
        Source("NautilusMetadata", LOCAL, "File", "*.xml", "text/xml"),
        Source("NetworkServices", NEIGHBORHOOD, "File"),
        Source("Opera", LOCAL, "WebHistory", "*", "text/html"),
        Source("Pidgin", LOCAL, "IMLog", "*.{html,txt}", "siftwell/x-pidgin-log"),
        Source("Thunderbird", LOCAL, "MailMessage", "*", "application/mbox"),
        Source("Tomboy", LOCAL, "Note", "*.note", "text/xml"),
    )
}


def register(source: Source) -> None:
    SOURCES[source.name] = source


def excluded(path, names: list[str]):
    """If a path, or a folder above it, is hidden or fits a glob or a /pattern/."""
    patterns = [r"(?:^|/)\.[^/]+"]
    for n in names:
        patterns.append(n[1:-1] if len(n) > 1 and n.startswith("/") and n.endswith("/") else r"(?:^|/)" + re.sub(r"\\Z$|\\z$", "", fnmatch.translate(n)).replace("(?s:", "(?:").replace(".*", "[^/]*") + r"(?:/|$)")
    return path.rlike("|".join(f"(?:{p})" for p in patterns))


def of_files(spark: SparkSession, path: str, source: Source, exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """The files of a folder, and what is in them, as documents of a source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", source.pattern)
    found = reader.load(path)
    below = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = "/" + re.sub("^[a-z]+:/*|^/+", "", path).rstrip("/")
    found = found.where(~excluded(F.substring(below, len(root) + 1, 1 << 20), exclude))
    mime = F.lit(source.mime_type).cast("string")
    rows = files.extract(found.select("path", "content", mime.alias("mime_type")))
    times = found.select(F.col("path").alias("__top"), F.col("modificationTime").alias("ts"))
    rows = rows.withColumn("__top", F.split_part("path", F.lit("#"), F.lit(1))).join(times, "__top", "left")
    name = F.regexp_extract("path", "[^/#]*$", 0)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    # What every file is found by: its exact name, its name in words, and its extension.
    own = properties(
        prop("k", "file:exact_name", name),
        prop("t", "file:name", stem),
        prop("t", "file:split_name", fuzzy_divide(stem)),
        prop("k", "file:extension", F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)), searched=False),
        prop("k", "file:parent", F.regexp_replace(F.regexp_extract("path", "^(.*)/", 1), "^[a-z]+:/*", "/"), searched=False),
        prop("k", "file:parent_name", F.regexp_extract("path", "([^/]*)/[^/]*$", 1), searched=False),
        prop("k", "file:type", F.col("file_type"), searched=False),
        prop("k", "file:mime_type", F.col("mime_type"), searched=False),
        prop("k", "file:hit_type", F.lit(source.hit_type), searched=False),
    )
    given = F.transform("properties", lambda p: F.struct(p["type"].alias("type"), p["key"].alias("key"), p["value"].alias("value"), F.lit(True).alias("searched"), F.lit(True).alias("stored"), F.lit(False).alias("mutable"), F.lit(False).alias("persistent")))
    return rows.select(
        F.col("path").alias("uri"),
        "parent_uri",
        "ts",
        F.lit(source.name).alias("source"),
        F.lit(source.domain).alias("domain"),
        F.lit(source.hit_type).alias("hit_type"),
        "mime_type",
        "file_type",
        "text",
        F.concat(own, given).alias("properties"),
    )


def changed_files(listing: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to read, gone): listing (path, mtime, filter_version) against what was read before (the same columns)."""
    return listing.join(state, ["path", "mtime", "filter_version"], "left_anti"), state.select("path").join(listing.select("path"), "path", "left_anti")


def rebased(docs: DataFrame, mount: str) -> DataFrame:
    """Documents of a removable index, whose URIs are relative, under the folder it is mounted at."""
    put = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(mount.rstrip("/") + "/"), F.regexp_replace(c, "^/+", "")))
    return docs.withColumns({"uri": put("uri"), "parent_uri": put("parent_uri")})


def listed(spark: SparkSession, names: DataFrame) -> DataFrame:
    """Documents of a list of paths alone (path, and mtime if known), without reading the files: what a locate database knows."""
    path, name = F.col("path"), F.regexp_extract("path", "[^/]*$", 0)
    props = properties(prop("k", "file:exact_name", name), prop("t", "file:split_name", fuzzy_divide(name)), prop("k", "file:parent", F.regexp_extract("path", "^(.*)/", 1), searched=False))
    none = F.lit(None).cast("string")
    ts = F.col("mtime").cast("timestamp") if "mtime" in names.columns else F.lit(None).cast("timestamp")
    return names.select(F.concat(F.lit("file://"), path).alias("uri"), none.alias("parent_uri"), ts.alias("ts"), F.lit("Locate").alias("source"), F.lit(SYSTEM).alias("domain"), F.lit("File").alias("hit_type"), none.alias("mime_type"), none.alias("text"), props.alias("properties"))


def folders(listing: DataFrame, most_depth: int = 64) -> DataFrame:
    """uid, path of folders (uid, parent_uid, name): names are joined up to a folder without a parent; one that is
    its own ancestor has no path. A round for each level."""
    found = level = written(listing.where(F.col("parent_uid").isNull()).select("uid", F.concat(F.lit("/"), F.regexp_replace("name", "^/+", "")).alias("path")), "folders")
    for _ in range(most_depth):
        if not level.limit(1).count():
            return found
        up = level.select(F.col("uid").alias("parent_uid"), F.col("path").alias("above"))
        level = written(listing.join(up, "parent_uid").select("uid", F.concat(F.regexp_replace("above", "/$", ""), F.lit("/"), "name").alias("path")), "folders")
        found = found.union(level)
    raise ValueError(f"folders are more than {most_depth} levels deep")


def resolved(hits: DataFrame, listing: DataFrame) -> DataFrame:
    """Hits whose URIs are uid:folder/name, with the present address of the file instead."""
    at = folders(listing).select(F.col("uid").alias("__uid"), "path")
    parts = hits.withColumn("__uid", F.regexp_extract("uri", "^uid:([^/]*)/", 1))
    found = parts.join(at, "__uid", "left")
    return found.withColumn("uri", F.when(F.col("path").isNotNull(), F.concat(F.lit("file://"), "path", F.lit("/"), F.regexp_extract("uri", "/(.*)$", 1))).otherwise(F.col("uri"))).drop("__uid", "path")

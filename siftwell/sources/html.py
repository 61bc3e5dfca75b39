"""HTML pages: title, meta tags, links and text, by expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.scalar import decode_entities

#: What stands in these isn't text.
SILENT = r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->"
#: Tags that part what they stand between.
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|section|nav|header|footer|title|head|body|html)\b[^>]*>"
LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def title(html: Column) -> Column:
    return decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """All addresses of anchors."""
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def recorded_links(html: Column) -> Column:
    """Those that are kept as links: of the schemes http, mailto and ftp."""
    return F.array_distinct(F.filter(links(html), lambda u: u.rlike("^(http|mailto|ftp):")))


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta\b[^>]*?\bname\s*=\s*[\"']{name}[\"'][^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)


def text(html: Column) -> Column:
    """What a reader sees, with single spaces."""
    seen = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SILENT, " "), BREAKS, " "), r"<[^>]*>", "")
    return F.btrim(F.regexp_replace(decode_entities(seen), r"\s+", " "))


def extract(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select("page_id", "url", title(h).alias("title"), text(h).alias("text"), recorded_links(h).alias("links"))

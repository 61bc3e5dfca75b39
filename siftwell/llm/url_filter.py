"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs fill a blocked Bloom filter, which is sized by their number. URLs that it surely doesn't
have pass at once; possible hits go on to an exact join with the list, which removes the false positives. Pages are
taken apart once and written beside the filter's verdict, without their HTML.
Rules of a host and a path beginning come first: a rule fits its host and all subdomains if the URL's path
starts with the rule's, and the longest fitting rule decides.

A canonical URL is the host without ``www.``, the path without a trailing slash, index page or ``.html``,
and the query without tracking parameters, in order; scheme, port and fragment don't count.

Hostile cases: a null URL, or one without ``://``, has an empty host and path, no canonical form, and is
allowed; repeated rows, and the rows of one URL on a third of all pages, are dealt out in the join; an empty list
or table works; columns besides page_id and url aren't read, and null ids stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bloom
from siftwell.llm.shared import ascii_lower, counted, even_join, forget, written

# The rules (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Query parameters that say where a visitor came from.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"


def parts(url: Column) -> dict[str, Column]:
    """host and path of a URL; both empty without ``://``."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return {"host": F.when(there, ascii_lower(host)).otherwise(F.lit("")), "path": F.when(there, path).otherwise(F.lit(""))}


def canonical(url: Column, host: Column, path: Column) -> Column:
    """The form in which a list has a URL; null without a host."""
    # \z, as $ also stands before a last line end. A parameter with a newline in it is none of the tracking ones.
    name = F.regexp_replace(F.regexp_replace(host, r":[0-9]*\z", ""), r"^www\.", "")
    place = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?\z", ""), r"/+\z", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=[^\n]*)?\z")))
    return F.when(host != "", F.concat(name, place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path in one string) and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def with_parts(pages: DataFrame) -> DataFrame:
    df = pages.select("page_id", F.col("url").cast("string").alias("url"))
    p = parts(F.col("url"))
    df = df.withColumns(p)
    return df.withColumn("canonical", canonical(F.col("url"), F.col("host"), F.col("path")))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical and listed of each row of pages (page_id, url).

    listed: canonical URLs in a column of that name, which are blocked where no rule decides.
    """
    listed = written(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "listed")
    blocks = bloom.blocks_for(listed.count())
    blooms = written(bloom.build(listed, "canonical", blocks), "bloom")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = with_parts(pages).withColumns({"rule": name, "ruled": verdict})
    columns = ["page_id", "host", "path", "rule", "ruled", "canonical"]
    df = written(bloom.probe(df, F.col("canonical"), blooms, "maybe", blocks).select(*columns, "maybe"), "pages")
    forget(blooms)
    hits = df.where("maybe").drop("maybe")
    exact = even_join(hits, listed.withColumn("listed", F.lit(True)), "canonical", counted(hits, "canonical"), hits.count(), "left")
    surely = df.where(~F.col("maybe")).withColumn("listed", F.lit(False)).select(*columns, "listed")
    both = surely.unionByName(exact.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed")))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "canonical", "listed")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The canonical URLs of the pages whose id is divisible by 50: the list of the registered query."""
    return with_parts(pages.where(F.col("page_id") % 50 == 0)).select("canonical")


def _sql_rule(column: str) -> str:
    cases = []
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        value = h + p if column == "rule" else v
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value}'")
    return "CASE " + " ".join(cases) + " END"


ORACLE = rf"""
WITH a AS (SELECT page_id, url, coalesce(contains(url, '://'), false) AS there, substr(url, instr(url, '://') + 3) AS rest FROM pages),
b AS (SELECT page_id, url,
  CASE WHEN there THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN there THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM a),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:{TRACKING})(?:=.*)?$'))) AS kept FROM b),
d AS (SELECT *, CASE WHEN host <> '' THEN concat(regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', ''),
  regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', ''), CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) END AS canonical FROM c),
e AS (SELECT DISTINCT canonical FROM d WHERE page_id % 50 = 0 AND canonical IS NOT NULL),
f AS (SELECT d.*, e.canonical IS NOT NULL AS listed, {_sql_rule("rule")} AS rule, {_sql_rule("verdict")} AS ruled FROM d LEFT JOIN e ON d.canonical = e.canonical)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, canonical, listed FROM f
"""

"""Scalar functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top-level domains dropped from addresses, and the entities that are decoded, in order.
DOMAINS = ["com", "net", "org", "edu", "gov", "mil"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("&nbsp;", " "), ("&apos;", "'")]

KB, MB = 1024, 1024 * 1024


def _digits(ts: Column, form: str) -> Column:
    """A time by a form; the sign that Java puts before years of more than four digits is left out."""
    return F.ltrim(F.date_format(ts, form), F.lit("+"))


def date_string(ts: Column) -> Column:
    """yyyyMMddHHmmss in UTC; years after 9999 have as many digits as they need."""
    return _digits(ts, "yyyyMMddHHmmss")


def year_month(ts: Column) -> Column:
    return _digits(ts, "yyyyMM")


def day(ts: Column) -> Column:
    return F.date_format(ts, "dd")


def parse_date(s: Column) -> Column:
    """The time that 14 digits give; null for anything else."""
    return F.when(s.rlike("^[0-9]{14}$"), F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss")))


def file_length(n: Column) -> Column:
    """Bytes as text: bytes, KB or MB with one decimal."""
    whole = F.concat(n.cast("string"), F.when(n == 1, F.lit(" byte")).otherwise(F.lit(" bytes")))
    return F.when(n < 0, F.lit("*BadLength*")).when(n < KB, whole).when(n < MB, F.format_string("%.1f KB", n / F.lit(float(KB)))).otherwise(F.format_string("%.1f MB", n / F.lit(float(MB))))


def fuzzy_divide(s: Column) -> Column:
    """Spaces for all but letters and digits, and between lower case or digits and what starts anew."""
    spaced = F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")
    parted = F.regexp_replace(spaced, r"(?<=\p{Ll})(?=[\p{Lu}\p{N}])|(?<=\p{N})(?=\p{L})|(?<=\p{Lu})(?=\p{N})", " ")
    return F.regexp_replace(parted, "^ ", "")


def url_fuzzy_divide(s: Column) -> Column:
    return fuzzy_divide(F.regexp_replace(s, "^.*?://", ""))


def strip_tags(s: Column) -> Column:
    """Without tags; an unmatched opening stays with the rest."""
    return F.regexp_replace(s, "<[^>]*>", "")


def decode_entities(s: Column) -> Column:
    for name, c in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(c))
    return s


def escape_html(s: Column) -> Column:
    for c, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")]:
        s = F.replace(s, F.lit(c), F.lit(name))
    return s


def valid_xml(s: Column) -> Column:
    """Characters that XML doesn't allow become spaces."""
    return F.regexp_replace(s, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}]", " ")


def sanitize_email(s: Column) -> Column:
    """Lower case, parted at @ . - _ +, without a common top-level domain at the end."""
    return F.regexp_replace(F.translate(F.lower(s), "@.-_+", "     "), " (" + "|".join(DOMAINS) + ")$", "")


def sanitize_path(s: Column) -> Column:
    """One leading slash at most, none at the end."""
    return F.regexp_replace(F.regexp_replace(s, "^/+", "/"), "(?<=.)/+$", "")


def count_words(s: Column, most: int = -1, least_length: int = -1) -> Column:
    """Words by white space, up to most; shorter ones don't count unless the text ends with one."""
    words = F.filter(F.split(F.coalesce(s, F.lit("")), r"\s+"), lambda w: w != "")
    if least_length > 0:
        closed = F.coalesce(s, F.lit("")).rlike(r"\s$")
        words = F.filter(words, lambda w, i: (F.length(w) >= least_length) | (~closed & (i == F.size(words) - 1)))
    n = F.size(words)
    return F.least(n, F.lit(most)) if most > 0 else n


def glob_regex(pattern: str) -> str:
    """The regular expression of a pattern in which only * is special."""
    return "^" + "".join(r"[\s\S]*" if c == "*" else _literal(c) for c in pattern) + "$"


def wildcard_regex(pattern: str) -> str:
    """* is any run, ? is one character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else _literal(c) for c in pattern) + "$"


def _literal(c: str) -> str:
    return c if c.isalnum() or c == " " else "\\" + c


def glob_match(pattern: str, s: Column) -> Column:
    if "*" not in pattern:
        return s == pattern
    return s.rlike(glob_regex(pattern))


def split_quoted(s: Column) -> Column:
    """Parts at spaces; what stands in double quotes is one part, without them."""
    parts = F.regexp_extract_all(s, F.lit(r'("[^"]*"|[^ "]+)'), F.lit(1))
    return F.transform(parts, lambda p: F.btrim(p, F.lit('"')))


def has_space(s: Column) -> Column:
    return s.rlike(r"\s")


def levenshtein_similarity(a: Column, b: str, prefix: int = 0) -> Column:
    """1 - distance / (prefix + the shorter rest's length)."""
    rest = F.least(F.length(a), F.lit(len(b))) - prefix
    return F.when(rest > 0, 1 - F.levenshtein(a, F.lit(b)) / (prefix + rest)).otherwise(F.lit(0.0))


def duration(seconds: Column) -> Column:
    """Seconds as days, hours, minutes and seconds, leaving out what is zero."""
    d, h, m, s = F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60
    parts = [F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in ((d, "d"), (h, "h"), (m, "m"), (s, "s"))]
    return F.when(seconds == 0, F.lit("0s")).otherwise(F.array_join(F.array_compact(F.array(*parts)), ""))


def half_life(days: Column, days_to_half: float = 182.0) -> Column:
    return F.pow(F.lit(0.5), days / days_to_half)


def fold_accents(s: Column) -> Column:
    """ISO-8859-1 letters without their accents."""
    s = F.translate(s, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIIDNOOOOOOUUUUYaaaaaaceeeeiiiidnoooooouuuuyy")
    for a, b in [("Æ", "AE"), ("Œ", "OE"), ("Þ", "TH"), ("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th")]:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# --- dates and durations that people read --------------------------------------------------------------------------


def fuzzy_date(ts: Column, now: Column, twelve_hours: bool = False) -> Column:
    """Today, Yesterday, the weekday within a week, the day within the year, or the whole date; with the time of day."""
    days = F.datediff(now, ts)
    clock = F.date_format(ts, "h:mm a" if twelve_hours else "HH:mm")
    day = F.when(days == 0, "Today").when(days == 1, "Yesterday").when((days > 1) & (days < 7), F.date_format(ts, "EEEE"))
    day = day.when(F.year(ts) == F.year(now), F.date_format(ts, "MMMM d")).otherwise(F.replace(F.date_format(ts, "MMMM d, yyyy"), F.lit("+"), F.lit("")))
    return F.concat_ws(" ", day, clock)


def pretty_date(ts: Column, now: Column) -> Column:
    """Today, Yesterday, so many days ago within a week, or the date."""
    days = F.datediff(now, ts)
    ago = F.concat(days.cast("string"), F.lit(" days ago"))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when((days > 1) & (days < 7), ago).otherwise(_digits(ts, "yyyy-MM-dd"))


def pretty_duration(seconds: Column) -> Column:
    """Hours and minutes in words; less than a minute is said so."""
    h, m = F.floor(seconds / 3600), F.floor(seconds / 60) % 60

    def counted(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise("")))

    words = F.concat_ws(" ", counted(h, "hour"), counted(m, "minute"))
    return F.when(seconds < 60, "less than a minute").otherwise(words)


def from_unix_time(seconds: Column) -> Column:
    """The time, in UTC, so many seconds after the beginning of 1970."""
    return F.timestamp_seconds(seconds)


#: What a date is cut down to: its name, how Spark cuts and how it is written.
RESOLUTIONS = {"year": ("YEAR", "yyyy"), "month": ("MONTH", "yyyyMM"), "day": ("DAY", "yyyyMMdd"), "hour": ("HOUR", "yyyyMMddHH"), "minute": ("MINUTE", "yyyyMMddHHmm"), "second": ("SECOND", "yyyyMMddHHmmss"), "millisecond": ("MILLISECOND", "yyyyMMddHHmmssSSS")}


def date_at(ts: Column, resolution: str) -> Column:
    """A time as digits of a resolution; texts of one resolution sort as times do until the year 9999."""
    unit, form = RESOLUTIONS[resolution]
    return _digits(F.date_trunc(unit, ts), form)


def number_string(n: Column, width: int = 14) -> Column:
    """A whole number as a text that sorts as numbers do: a sign, and base 36 with leading zeros (from the least number on below zero)."""
    wide = n.cast("decimal(20,0)")
    above = F.when(n < 0, wide + F.lit(str(2**63)).cast("decimal(20,0)")).otherwise(wide)
    digits = F.lpad(F.lower(F.conv(above.cast("string"), 10, 36)), width - 1, "0")
    return F.concat(F.when(n < 0, "-").otherwise("0"), digits)


def string_number(s: Column) -> Column:
    """The whole number that number_string() has written; null for anything else."""
    digits = F.conv(F.upper(F.substring(s, 2, 64)), 36, 10).try_cast("decimal(20,0)")
    return F.when(s.rlike("^[-0][0-9a-z]+$"), (digits - F.when(s.startswith("-"), F.lit(str(2**63)).cast("decimal(20,0)")).otherwise(F.lit(0))).try_cast("bigint"))


# --- addresses -----------------------------------------------------------------------------------------------------

#: Characters that stand as they are in an address.
_PLAIN = "A-Za-z0-9/:._~!$&'()*+,;=@-"


def hex_escape(s: Column) -> Column:
    """Bytes of UTF-8 that aren't plain as %XX."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    pairs = lambda c: F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(f"^[{_PLAIN}]$"), c).otherwise(pairs(c))), "")


def hex_unescape(s: Column) -> Column:
    """%XX taken back to bytes of UTF-8; a percent sign without two digits stays."""
    whole = F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B")))


def path_uri(path: Column) -> Column:
    """The address of a file."""
    return F.concat(F.lit("file://"), hex_escape(path))


def uri_path(uri: Column) -> Column:
    """The path of a file's address; null for other schemes."""
    return F.when(uri.startswith("file://"), hex_unescape(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), "#.*$", "")))


def with_fragment(uri: Column, fragment: Column) -> Column:
    """The address of a part of a document; a part of a part goes on behind a colon."""
    return F.concat(uri, F.when(uri.contains("#"), ":").otherwise("#"), fragment)


def same_uri(a: Column, b: Column) -> Column:
    """If addresses are the same however they are escaped; the fragment counts."""
    return hex_unescape(a).eqNullSafe(hex_unescape(b))


def short_guid(guid: Column) -> Column:
    """The 16 bytes of a GUID in 22 letters that an address may have."""
    return F.translate(F.rtrim(F.base64(F.unhex(F.replace(guid, F.lit("-"), F.lit("")))), F.lit("=")), "+/", "-_")


def long_guid(short: Column) -> Column:
    """A GUID from its short form."""
    h = F.lower(F.hex(F.unbase64(F.concat(F.translate(short, "-_", "+/"), F.lit("==")))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def guid_uri(guid: Column) -> Column:
    return F.concat(F.lit("uid:"), short_guid(guid))


# --- versions, patterns and terms ------------------------------------------------------------------------------------


def is_newer(ts: Column, other: Column) -> Column:
    """If a version is newer: one with a time is newer than one without."""
    return F.when(ts.isNull(), F.lit(False)).otherwise(F.coalesce(ts > other, F.lit(True)))


def is_obsoleted(ts: Column, other: Column) -> Column:
    """If another version takes its place: one that isn't older and has a time."""
    return F.when(other.isNull(), F.lit(False)).otherwise(F.coalesce(ts <= other, F.lit(True)))


def pattern_regex(patterns: list[str]) -> str:
    """One regular expression for names: globs and /expressions/; one that can't be read is left out."""
    parts = []
    for p in patterns:
        if len(p) > 1 and p.startswith("/") and p.endswith("/"):
            try:
                re.compile(p[1:-1])
            except re.error:
                continue
            parts.append(p[1:-1])
        elif p:
            parts.append(glob_regex(p)[1:-1])
    return "^(?:" + "|".join(f"(?:{p})" for p in parts) + ")$"


def found_terms(s: Column, terms: list[str], whole_words: bool = True) -> Column:
    """The terms, in the order given, that a text has; whole words if asked, whatever the case."""
    edge = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])") if whole_words else ("", "")
    tests = [F.when(s.rlike("(?i)" + edge[0] + "".join(_literal(c) for c in t) + edge[1]), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*tests))


def expand_variables(s: str, environment: Mapping[str, str] | None = None) -> str | None:
    """A path with $NAME replaced on the driver; null if the last variable isn't set, others that aren't become empty."""
    environment = os.environ if environment is None else environment
    names = re.findall(r"\$(\w+)", s)
    if names and names[-1] not in environment:
        return None
    return re.sub(r"\$(\w+)", lambda m: environment.get(m[1], ""), s)


def without_html(s: Column) -> Column:
    """Lines of a feed without tags and entities."""
    return F.array_join(F.transform(F.split(s, "\r?\n"), lambda x: decode_entities(strip_tags(x))), "\n")

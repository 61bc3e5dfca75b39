"""The language that people type: terms, phrases, wildcards, key:value, dates, OR and minus."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from siftwell.plans.parts import PROHIBITED, REQUIRED, DateRange, Or, Part, Property, Query, Text, Uri, Wildcard

# The keywords and the properties that each stands for, with their types.
KEYWORDS = {
    "artist": [("t", "fixme:artist")],
    "mailto": [("t", "parent:fixme:to_name"), ("t", "fixme:to_name")],
    "author": [("t", "dc:author")],
    "summary": [("t", "dc:subject")],
    "imagemodel": [("t", "exif:Model")],
    "imagecomment": [("t", "iptc:caption"), ("t", "exif:UserComment"), ("t", "jfif:Comment"), ("t", "digikam:caption"), ("t", "fspot:Description")],
    "speakingto": [("k", "fixme:speakingto")],
    "mailtoaddr": [("t", "parent:fixme:to_address"), ("t", "fixme:to_address")],
    "inattachment": [("k", "parent:fixme:hasAttachments")],
    "imagetag": [("t", "image:tag")],
    "source": [("k", "dc:source")],
    "creator": [("t", "dc:creator")],
    "emblem": [("k", "nautilus:emblem")],
    "mailinglist": [("t", "parent:fixme:mlist"), ("t", "fixme:mlist")],
    "mailfrom": [("t", "parent:fixme:from_name"), ("t", "fixme:from_name")],
    "genre": [("k", "fixme:genre")],
    "email": [("t", "vCard:EMAIL")],
    "host": [("t", "fixme:host")],
    "notetag": [("t", "note:tag")],
    "title": [("t", "dc:title")],
    "mailfromaddr": [("t", "parent:fixme:from_address"), ("t", "fixme:from_address")],
    "pkggroup": [("t", "pkg:group")],
    "inarchive": [("k", "fixme:inside_archive")],
    "album": [("t", "fixme:album")],
    "language": [("k", "dc:language")],
    "filetype": [("k", "file:type")],
    "mimetype": [("k", "file:mime_type")],
    "type": [("k", "file:hit_type")],
    "filename": [("t", "file:name"), ("t", "file:split_name")],
}
EXTENSION_KEY = "file:extension"
PARENT_KEY, PARENT_NAME_KEY = "file:parent", "file:parent_name"

_TOKEN = re.compile(r'([+-]?)(?:([^\s":]+):)?(?:"([^"]*)"?|([^\s"]+(?:"[^"]*"?)?))')
#: A point and an extension, whatever stars are before it.
_EXTENSION = re.compile(r"[*]*[.](?:[^\W]+)?")


def _day(s: str) -> tuple[datetime, datetime] | None:
    """First and last second of a year, month or day."""
    try:
        if len(s) == 4:
            a = datetime.strptime(s, "%Y")
            return a, a.replace(year=a.year + 1) - timedelta(seconds=1)
        if len(s) == 6:
            a = datetime.strptime(s, "%Y%m")
            return a, (a + timedelta(days=32)).replace(day=1) - timedelta(seconds=1)
        if len(s) == 8:
            a = datetime.strptime(s, "%Y%m%d")
            return a, a + timedelta(days=1, seconds=-1)
    except ValueError:
        pass
    return None


def _date(value: str) -> DateRange | None:
    a, dash, b = value.partition("-")
    if not dash:
        found = _day(a)
        return DateRange(*found) if found else None
    low, high = _day(a), _day(b)
    if low is None and high is None:
        return None
    return DateRange(low[0] if low else None, high[1] if high else None)


def in_folder(value: str) -> Property:
    """What is in a folder: of this path, or of this name wherever it is."""
    path = value.removeprefix("file://")
    return Property("k", PARENT_KEY, path.rstrip("/") or "/") if path.startswith("/") else Property("k", PARENT_NAME_KEY, path)


def _part(key: str | None, value: str, quoted: bool, whole: str) -> Part:
    if key is None:
        if not quoted and _EXTENSION.fullmatch(value):
            return Property("k", EXTENSION_KEY, "." + value.lstrip("*")[1:].lower())
        return Wildcard(value) if "*" in value else Text(value)
    if key.lower() in ("ext", "extension"):
        return Property("k", EXTENSION_KEY, "." + value.lstrip(".").lower())
    if key == "date":
        return _date(value) or Text(whole)
    if key == "uri":
        return Uri(value)
    if key == "inuri":
        return in_folder(value)
    if key in ("property", "keyword") and "=" in value:
        name, _, v = value.partition("=")
        return Property("t" if key == "property" else "k", name, v)
    mapped = KEYWORDS.get(key)
    if mapped is None:
        return Text(whole)
    parts: list[Part] = [Property(kind, name, value) for kind, name in mapped]
    return parts[0] if len(parts) == 1 else Or(parts)


def parse(text: str) -> Query:
    """A query of Required and Prohibited parts; neighbours of OR are folded into one part.

    A pending OR list that nothing follows is lost.
    """
    parts: list[Part] = []
    pending: list[Part] | None = None
    last_or = False
    for sign, key, quoted, word in _TOKEN.findall(text):
        whole = (key + ":" if key else "") + (word or quoted)
        if not key and word and word.upper() == "OR" and not sign:
            if parts or pending:
                if pending is None:
                    pending = [parts.pop()]
                last_or = True
            continue
        value = word.replace('"', "") if word else quoted
        part = _part(key or None, value, not word, whole)
        part.logic = PROHIBITED if sign == "-" else REQUIRED
        if last_or and pending is not None:
            pending.append(part)
            last_or = False
            continue
        if pending is not None:
            parts.append(Or(pending))
            pending = None
        parts.append(part)
    if pending is not None and not last_or:
        parts.append(Or(pending))
    return Query(parts)


def quoted_text(text: str) -> str:
    """The text of a query as it would be quoted."""
    return " ".join(f'"{q or w}"' for _, _, q, w in _TOKEN.findall(text))


def search_terms(query: Query, terms) -> list[str]:
    """The distinct terms of the Required text parts; terms is an analyzer's function."""
    out: list[str] = []

    def walk(p: Part) -> None:
        if isinstance(p, Or):
            for x in p.parts:
                walk(x)
        elif isinstance(p, Text) and p.logic == REQUIRED:
            out.extend(t for t in terms(p.text) if t not in out)

    for p in query.parts:
        walk(p)
    return out

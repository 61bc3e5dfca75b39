"""Files of many formats: text, typed properties, links and children, by Python's standard library.

An extractor is a function of a file's bytes; it is found by mime type, then by extension. Files are read with
Spark's binaryFile source; a file that can't be read gives no text and says why. extract() is an Arrow
stage, one file after another, so its memory is bounded by the largest file and its children. (Spark lists no empty files.)
"""

from __future__ import annotations

import bz2
import configparser
import csv
import email
import email.policy
import gzip
import io
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.shipping import ship



@dataclass
class Limits:
    """What is taken from an archive at most: members, bytes of a member and of all. What is left out is said in fixme:left_out."""

    children: int = 30
    member: int = 10 << 20
    total: int = 25 << 20


LIMITS = Limits()

EXTRACTED = "path string, parent_uri string, mime_type string, file_type string, text string, properties array<struct<type:string,key:string,value:string>>, links array<string>, error string"


@dataclass
class Extracted:
    """What a file holds. Properties are (type, key, value); children are (name, mime type or null, bytes)."""

    file_type: str = "document"
    text: str = ""
    properties: list[tuple[str, str, str]] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    children: list[tuple[str, str | None, bytes]] = field(default_factory=list)

    def add(self, kind: str, key: str, value: object) -> None:
        if value not in (None, ""):
            self.properties.append((kind, key, str(value)))


Extractor = Callable[[bytes], Extracted]
BY_TYPE: dict[str, Extractor] = {}
BY_EXTENSION: dict[str, Extractor] = {}


def register(*names: str) -> Callable[[Extractor], Extractor]:
    """Mime types, or extensions with their dot."""

    def put(f: Extractor) -> Extractor:
        for n in names:
            (BY_EXTENSION if n.startswith(".") else BY_TYPE)[n] = f
        return f

    return put


def _str(data: bytes) -> str:
    for encoding in ("utf-8-sig", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


@register("text/plain", "text/x-log", "text/x-readme", "text/x-install", "text/x-credits", "text/x-authors", "text/x-copying", ".txt", ".log", ".md")
def plain(data: bytes) -> Extracted:
    return Extracted(text=_str(data))


class _Page(HTMLParser):
    """Text, emphasised or not, of what a reader sees; title, meta tags and links."""

    SILENT, BREAKS, SPACES = {"script", "style", "map"}, {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}, {"td", "a", "option"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.found, self.hidden, self.in_title, self.title = [], Extracted(), 0, False, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SILENT:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and a.get("name") and a.get("content"):
            self.found.add("t", "meta:" + a["name"].lower(), a["content"])
        elif tag == "a" and a.get("href"):
            if re.match(r"http://|mailto:|ftp://", a["href"]):
                self.found.links.append(a["href"])
            self.out.append(" " + unquote(a["href"]) + " ")
        elif tag == "img" and a.get("alt"):
            self.out.append(" " + a["alt"] + " ")
        self.out.append("\n" if tag in self.BREAKS else " " if tag in self.SPACES else "")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        self.out.append("\n" if tag in self.BREAKS else " " if tag in self.SPACES else "")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data)


@register("text/html", "application/xhtml+xml", ".html", ".htm", ".xhtml")
def page(data: bytes) -> Extracted:
    parser = _Page()
    parser.feed(_str(data))
    parser.close()
    found = parser.found
    found.add("t", "dc:title", "".join(parser.title).strip())
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    found.text = "\n".join(x for x in lines if x)
    return found


@register("message/rfc822", ".eml")
def mail(data: bytes) -> Extracted:
    message = email.message_from_bytes(data, policy=email.policy.default)
    found = Extracted("mail")
    found.add("t", "dc:title", message["subject"])
    try:
        found.add("d", "fixme:date", parsedate_to_datetime(str(message["date"])).strftime("%Y%m%d%H%M%S") if message["date"] else None)
    except (ValueError, TypeError):
        pass
    for header in ("to", "cc", "from"):
        for name, address in getaddresses([str(h) for h in message.get_all(header, [])]):
            found.add("k", f"fixme:{header}", f"{name} <{address}>".strip() if name else address)
            found.add("k", f"fixme:{header}_address", address)
            found.add("t", f"fixme:{header}_name", name)
    found.add("k", "fixme:msgid", str(message["message-id"] or "").strip("<> \t"))
    for reference in re.findall(r"<([^>]+)>", f"{message['references'] or ''} {message['in-reply-to'] or ''}"):
        found.add("k", "fixme:reference", reference)
    found.add("t", "fixme:mlist", re.sub(r"^.*<|>.*$", "", str(message["list-id"] or "")))
    texts = []
    for part in message.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment" or part.get_filename():
            found.children.append((part.get_filename() or f"part{len(found.children) + 1}", part.get_content_type(), body))
        elif part.get_content_type() == "text/html":
            texts.append(page(body).text)
        elif part.get_content_maintype() == "text":
            texts.append(_str(body))
    if found.children:
        found.add("k", "fixme:hasAttachments", "true")
    found.text = "\n".join(texts)
    return found


def _members(pairs: Iterator[tuple[str, int, Callable[[], bytes]]]) -> Extracted:
    """Names of all members as text, and the first ones that aren't too large as children."""
    found, total, names, left_out = Extracted("archive"), 0, [], 0
    for name, size, read in pairs:
        names.append(name)
        if len(found.children) < LIMITS.children and size <= LIMITS.member and total + size <= LIMITS.total:
            total += size
            found.children.append((name, None, read()))
        else:
            left_out += 1
    found.add("k", "fixme:left_out", left_out or None)
    found.text = "\n".join(names)
    return found


@register("application/zip", "application/x-zip", "application/x-zip-compressed", ".zip", ".jar")
def zipped(data: bytes) -> Extracted:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _members((i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir())


@register("application/x-tar", "application/x-compressed-tar", "application/x-bzip-compressed-tar", "application/x-tgz", ".tar", ".tgz", ".tar.gz", ".tar.bz2")
def tarred(data: bytes) -> Extracted:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return _members((m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in t if m.isfile())


@register("application/x-gzip", "application/gzip", ".gz")
def gzipped(data: bytes) -> Extracted:
    inner = gzip.GzipFile(fileobj=io.BytesIO(data)).read(LIMITS.member)
    return Extracted("archive", children=[("contents", None, inner)])


@register("application/x-bzip", "application/x-bzip2", ".bz2")
def bzipped(data: bytes) -> Extracted:
    return Extracted("archive", children=[("contents", None, bz2.BZ2File(io.BytesIO(data)).read(LIMITS.member))])


#: Comment marks of source languages: to the end of the line, pairs, and what quotes strings.
_C = (["//"], [("/*", "*/")], "\"'")
_HASH = (["#"], [], "\"'")
LANGUAGES = {
    "text/x-csrc": _C, "text/x-chdr": _C, "text/x-c": _C, "text/x-c++src": _C, "text/x-c++": _C, "text/x-csharp": _C, "text/x-java": _C, "text/x-php": (["//", "#"], [("/*", "*/")], "\"'"), ".js": _C,
    "text/x-python": (["#"], [('"""', '"""'), ("'''", "'''")], "\"'"), "text/x-perl": _HASH, "application/x-perl": _HASH, "application/x-ruby": _HASH, "application/x-shellscript": _HASH, "application/x-sh": _HASH,
    "text/x-boo": (["#", "//"], [("/*", "*/"), ('"""', '"""')], "\"'"), "text/x-pascal": (["//"], [("{", "}"), ("(*", "*)")], "'"), "text/x-fortran": (["!"], [], "\"'"), "text/x-scheme": ([";"], [("#|", "|#")], '"'), ".m": (["%"], [], "\"'"), ".sci": (["//"], [], "\"'"),
    ".c": _C, ".h": _C, ".cpp": _C, ".cs": _C, ".java": _C, ".py": (["#"], [('"""', '"""'), ("'''", "'''")], "\"'"), ".pl": _HASH, ".rb": _HASH, ".sh": _HASH,
}


def _source(lines: list[str], pairs: list[tuple[str, str]], quotes: str) -> Extractor:
    """The words of code once each, and comments and strings in full."""
    either = "|".join([*(re.escape(a) + r"(?P<c%d>[\s\S]*?)(?:%s|\Z)" % (k, re.escape(b)) for k, (a, b) in enumerate(pairs)), *(re.escape(x) + rf"(?P<l{k}>[^\n]*)" for k, x in enumerate(lines)), *(rf"{q}(?P<s{k}>(?:\\.|[^\\\n{q}])*){q}?" for k, q in enumerate(quotes))])
    pattern = re.compile(either)

    def run(data: bytes) -> Extracted:
        text, out, at, words = _str(data), [], 0, {}
        for m in pattern.finditer(text):
            words.update(dict.fromkeys(re.findall(r"[^\W\d]\w*", text[at : m.start()])))
            out.append(next((g for g in m.groupdict().values() if g is not None), ""))
            at = m.end()
        words.update(dict.fromkeys(re.findall(r"[^\W\d]\w*", text[at:])))
        return Extracted("source", "\n".join([" ".join(words), *(x.strip() for x in out if x.strip())]))

    return run


for _name, _marks in LANGUAGES.items():
    register(_name)(_source(*_marks))


@register("application/x-desktop", ".desktop")
def desktop(data: bytes) -> Extracted:
    """Names and comments in all languages, categories and the command."""
    parser = configparser.RawConfigParser(strict=False, delimiters=("=",), comment_prefixes=("#",), interpolation=None)
    parser.optionxform = str
    parser.read_string(_str(data))
    found = Extracted("application")
    for key, value in (parser["Desktop Entry"] if "Desktop Entry" in parser else {}).items():
        base = key.partition("[")[0]
        if base in ("Name", "Comment", "GenericName", "Keywords"):
            found.add("t", f"fixme:{base.lower()}", value)
        elif base in ("Exec", "Categories", "MimeType", "Icon"):
            found.add("k", f"fixme:{base.lower()}", value)
    found.text = "\n".join(v for t, _, v in found.properties if t == "t")
    return found


@register("text/csv", "text/comma-separated-values", "application/csv", ".csv")
def comma_separated(data: bytes) -> Extracted:
    return Extracted("document", "\n".join(" ".join(c for c in row if c) for row in csv.reader(io.StringIO(_str(data)))))


@register("text/tab-separated-values", "application/tab-separated-values", ".tsv")
def tab_separated(data: bytes) -> Extracted:
    return Extracted("document", _str(data).replace("\t", " "))


@register("text/x-bibtex", ".bib")
def bibtex(data: bytes) -> Extracted:
    text, found = _str(data), Extracted()
    for key, a, b in re.findall(r"(?im)^\s*(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\")", text):
        found.add("t", {"title": "dc:title", "author": "dc:author"}.get(key.lower(), f"bibtex:{key.lower()}"), re.sub(r"[{}]", "", a or b))
    found.text = "\n".join(v for _, _, v in found.properties)
    return found


@register("audio/x-mpegurl", ".m3u", "audio/x-scpls", ".pls")
def playlist(data: bytes) -> Extracted:
    text = _str(data)
    titles = re.findall(r"(?m)^#EXTINF:[^,\n]*,(.*)$|^Title\d+=(.*)$", text)
    files = re.findall(r"(?m)^(?!#|\[|Title|Length|NumberOf|Version)(?:File\d+=)?(\S.*)$", text)
    return Extracted("audio", "\n".join([*(a or b for a, b in titles), *(f.strip() for f in files)]))


@register("application/rtf", "text/rtf", ".rtf")
def rich_text(data: bytes) -> Extracted:
    """Text outside of the tables of fonts, colours, styles and the like; info as properties."""
    text, found = data.decode("latin-1"), Extracted()
    for key, name in (("title", "dc:title"), ("author", "dc:author"), ("subject", "dc:subject")):
        m = re.search(rf"\{{\\{key} ([^{{}}]*)\}}", text)
        found.add("t", name, m and m[1])
    out, stack, hidden, skip = [], [], False, 1
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}]+)", text):
        word, number, code, sign, brace, run = m.groups()
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            hidden, skip = stack.pop() if stack else (False, 1)
        elif word:
            if word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "listtable", "generator"):
                hidden = True
            elif word in ("par", "line", "tab", "cell", "row") and not hidden:
                out.append("\n" if word in ("par", "line", "row") else " ")
            elif word == "uc":
                skip = int(number or 1)
            elif word == "u" and number and not hidden:
                out.append(chr(int(number) % 65536))
        elif sign == "*":
            hidden = True
        elif not hidden:
            out.append(bytes.fromhex(code).decode("cp1252", "replace") if code else sign if sign in ("\\", "{", "}") else re.sub(r"[\r\n]", "", run or ""))
    found.text = "".join(out).strip()
    return found


@register("text/x-tex", "text/x-latex", "application/x-tex", "application/x-latex", ".tex")
def latex(data: bytes) -> Extracted:
    text, found = re.sub(r"(?m)(?<!\\)%.*$", "", _str(data)), Extracted()
    for key, name in (("title", "dc:title"), ("author", "dc:author")):
        m = re.search(rf"\\{key}\s*\{{([^{{}}]*)\}}", text)
        found.add("t", name, m and m[1])
    body = re.sub(r"\\(?:begin|end|usepackage|documentclass|label|ref|cite)(?:\[[^\]]*\])?\{[^{}]*\}", " ", text)
    found.text = re.sub(r"[ \t]+", " ", re.sub(r"[{}$&~]|\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ", body)).strip()
    return found


@register("application/x-troff-man", "text/x-troff-man", "application/x-troff", "text/x-troff", "text/troff", ".man")
def manual(data: bytes) -> Extracted:
    found, out = Extracted("documentation"), []
    for line in _str(data).split("\n"):
        if line.startswith((".\\\"", "'\\\"")):
            continue
        m = re.match(r"\.TH\s+\"?([^\s\"]+)", line)
        if m:
            found.add("t", "dc:title", m[1])
        out.append(re.sub(r"\\f.|\\-|\\&|\\\(..", lambda x: "-" if x[0] == "\\-" else "", re.sub(r"^\.[A-Za-z]{1,2}\s*", "", line)).strip('" '))
    found.text = "\n".join(x for x in out if x)
    return found


def _xml_text(root: ElementTree.Element) -> str:
    return "\n".join(x.strip() for x in root.itertext() if x.strip())


@register("application/docbook+xml", ".docbook", "image/svg+xml", ".svg", "text/x-xslt", "application/xslt+xml", ".xslt", "application/x-abiword", ".abw", "application/x-scribus", ".sla", "application/monodoc", "text/xml", "application/xml", ".xml")
def xml(data: bytes) -> Extracted:
    root, found = ElementTree.fromstring(data), Extracted()
    title = next((e for e in root.iter() if e.tag.rpartition("}")[2] == "title"), None)
    found.add("t", "dc:title", title is not None and "".join(title.itertext()).strip())
    found.text = _xml_text(root)
    return found


@register("application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.oasis.opendocument.presentation", "application/vnd.sun.xml.writer", "application/vnd.sun.xml.calc", ".odt", ".ods", ".odp", ".sxw")
def open_document(data: bytes) -> Extracted:
    found = Extracted()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found.text = _xml_text(ElementTree.fromstring(z.read("content.xml")))
        if "meta.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("meta.xml")).iter():
                name = e.tag.rpartition("}")[2]
                if name in ("title", "subject", "description", "creator", "keyword"):
                    found.add("t", f"dc:{name}", (e.text or "").strip())
    return found


@register("text/calendar", "text/x-vcalendar", "text/x-vcard", "text/directory", ".ics", ".vcf")
def calendar(data: bytes) -> Extracted:
    found = Extracted()
    for line in re.sub(r"\r?\n[ \t]", "", _str(data)).splitlines():
        name, _, value = line.partition(":")
        name = name.partition(";")[0].upper()
        if name in ("SUMMARY", "DESCRIPTION", "LOCATION", "FN", "N", "ORG", "NOTE", "CATEGORIES", "EMAIL", "TEL"):
            found.add("t", f"vCard:{name}", value.replace("\\,", ",").replace("\\n", "\n"))
    found.text = "\n".join(v for _, _, v in found.properties)
    return found


@register("application/rss+xml", "application/atom+xml", ".rss", ".atom")
def feed(data: bytes) -> Extracted:
    found = Extracted("feed")
    for item in (e for e in ElementTree.fromstring(data).iter() if e.tag.rpartition("}")[2] in ("item", "entry")):
        parts = {c.tag.rpartition("}")[2]: "".join(c.itertext()) for c in item}
        body = page((parts.get("description") or parts.get("content") or parts.get("summary") or "").encode()).text
        found.children.append((parts.get("guid") or parts.get("id") or parts.get("link") or f"item{len(found.children) + 1}", "text/plain", f"{parts.get('title', '')}\n{body}".encode()))
    return found


def _image(width: int, height: int, **more: object) -> Extracted:
    found = Extracted("image")
    for k, v in {"fixme:width": width, "fixme:height": height, **more}.items():
        found.add("k", k, v)
    return found


@register("image/png", ".png")
def png(data: bytes) -> Extracted:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    found = _image(*struct.unpack(">II", data[16:24]), **{"fixme:depth": data[24]})
    for m in re.finditer(rb"tEXt([^\0]{1,79})\0", data):
        size = struct.unpack(">I", data[m.start() - 4 : m.start()])[0]
        found.add("t", "png:" + m[1].decode("latin-1"), data[m.end() : m.start() + 4 + size].decode("latin-1"))
    return found


@register("image/gif", ".gif")
def gif(data: bytes) -> Extracted:
    if data[:3] != b"GIF":
        raise ValueError("no GIF")
    return _image(*struct.unpack("<HH", data[6:10]))


@register("image/bmp", ".bmp")
def bmp(data: bytes) -> Extracted:
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    width, height = struct.unpack("<ii", data[18:26])
    return _image(width, abs(height), **{"fixme:depth": struct.unpack("<H", data[28:30])[0]})


@register("image/jpeg", ".jpg", ".jpeg")
def jpeg(data: bytes) -> Extracted:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return _image(width, height)
        at += 2 + size
    raise ValueError("no JPEG")


@register("application/x-object", "application/x-sharedlib", "application/x-java", "image/x-eps", "text/x-patch", "application/x-ms-dos-executable", ".o", ".so", ".class")
def ignored(data: bytes) -> Extracted:
    return Extracted("file")


def extractor(mime_type: str | None, path: str, data: bytes = b"") -> Extractor | None:
    """By mime type, by extension, and last by the first bytes."""
    name = path.rpartition("/")[2].lower()
    found = BY_TYPE.get(mime_type or "")
    while not found and "." in name:
        name = name.partition(".")[2]
        found = BY_EXTENSION.get("." + name)
    return found or BY_TYPE.get(more_files.sniffed(data) or "")


def rows_of(path: str, mime_type: str | None, data: bytes, parent: str | None = None, depth: int = 0) -> Iterator[tuple]:
    """A row for a file and one for each of its children."""
    found, error, run = Extracted("file"), None, extractor(mime_type, path, data)
    try:
        if run:
            found = run(data)
    except Exception as e:  # a file that can't be read is a document without content
        error = f"{type(e).__name__}: {e}"
    yield path, parent, mime_type, found.file_type, found.text, [dict(zip(("type", "key", "value"), p)) for p in found.properties], found.links, error
    if depth < 3:
        for name, kind, inner in found.children:
            child = f"{path}#{quote(name)}"
            for row in rows_of(child if "." in name or kind else f"{path.removesuffix('.gz').removesuffix('.bz2')}#{quote(name)}", kind, inner, path, depth + 1):
                yield row


def extract(files: DataFrame) -> DataFrame:
    """Rows of EXTRACTED for files (path, content, and mime_type if known)."""
    ship(files.sparkSession)
    mime = F.col("mime_type").cast("string") if "mime_type" in files.columns else F.lit(None).cast("string")
    names = [x.split()[0] for x in re.sub(r"<[^>]*(?:<[^>]*>)*[^>]*>", "", EXTRACTED).split(", ")]
    kinds = [pa.string()] * 5 + [pa.list_(pa.struct([("type", pa.string()), ("key", pa.string()), ("value", pa.string())])), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(batch.column(c) for c in ("path", "mime_type", "content"))):
                rows = list(rows_of(path.as_py(), kind.as_py(), data.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return files.select("path", mime.alias("mime_type"), "content").mapInArrow(run, EXTRACTED)


def read(spark, path: str) -> DataFrame:
    """Extracted files of a folder."""
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


from siftwell.sources import more_files  # noqa: E402  (registers its formats with the ones above)

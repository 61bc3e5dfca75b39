"""Further formats: packages, audio, video, TIFF, PDF, documentation, chat logs, mailboxes, and programs of one's own."""

from __future__ import annotations

import gzip
import io
import lzma
import mailbox
import re
import shlex
import struct
import subprocess
import tarfile
import tempfile
import zlib
from xml.etree import ElementTree

from siftwell.sources.files import _C, _HASH, Extracted, _image, _source, _str, mail, page, register

for _name, _marks in {
    "text/x-lisp": ([";"], [("#|", "|#")], '"'), "text/x-emacs-lisp": ([";"], [], '"'), ".lisp": ([";"], [("#|", "|#")], '"'), ".el": ([";"], [], '"'), ".scm": ([";"], [("#|", "|#")], '"'),
    "text/x-matlab": (["%"], [("%{", "%}")], "'"), "text/x-scilab": (["//"], [], "\"'"), ".sce": (["//"], [], "\"'"), "application/x-javascript": _C, "application/javascript": _C, "text/javascript": _C,
    "text/x-ebuild": _HASH, ".f": (["!"], [], "\"'"), ".pas": (["//"], [("{", "}"), ("(*", "*)")], "'"), ".php": (["//", "#"], [("/*", "*/")], "\"'"), ".boo": (["#", "//"], [("/*", "*/")], "\"'"),
}.items():
    register(_name)(_source(*_marks))


# --- packages ----------------------------------------------------------------------------------------------------------


def _package(name: object, version: object, summary: object, group: object, more: dict[str, object]) -> Extracted:
    found = Extracted("package")
    found.add("k", "pkg:name", name)
    found.add("k", "pkg:version", version)
    found.add("t", "dc:title", name)
    found.add("t", "dc:subject", summary)
    found.add("t", "pkg:group", group)
    for k, v in more.items():
        found.add("t", k, v)
    found.text = "\n".join(str(x) for x in (name, summary, more.get("dc:description")) if x)
    return found


@register("text/x-ebuild-package", ".ebuild")
def ebuild(data: bytes) -> Extracted:
    values = {k: v for k, _, v in re.findall(r"(?m)^(\w+)=(\"|')([\s\S]*?)\2", _str(data))}
    return _package(values.get("PN"), values.get("PV"), values.get("DESCRIPTION"), None, {"pkg:homepage": values.get("HOMEPAGE"), "pkg:license": values.get("LICENSE")})


@register("application/x-deb", ".deb")
def debian(data: bytes) -> Extracted:
    """The control file in an ar archive."""
    if data[:8] != b"!<arch>\n":
        raise ValueError("no package")
    at = 8
    while at + 60 <= len(data):
        name, size = data[at : at + 16].decode().strip().rstrip("/"), int(data[at + 48 : at + 58])
        body = data[at + 60 : at + 60 + size]
        if name.startswith("control.tar"):
            body = gzip.decompress(body) if name.endswith("gz") else lzma.decompress(body) if name.endswith("xz") else body
            with tarfile.open(fileobj=io.BytesIO(body)) as t:
                control = next(m for m in t if m.name.rpartition("/")[2] == "control")
                text = t.extractfile(control).read().decode("utf-8", "replace")
            values = {k.lower(): re.sub(r"\n ", "\n", v).strip() for k, v in re.findall(r"(?m)^([\w-]+):((?:.*)(?:\n .*)*)", text)}
            summary, _, more = values.get("description", "").partition("\n")
            return _package(values.get("package"), values.get("version"), summary, values.get("section"), {"dc:description": more, "pkg:maintainer": values.get("maintainer"), "pkg:requires": values.get("depends")})
        at += 60 + size + size % 2
    raise ValueError("no control file")


# Header tags that are read.
_RPM = {1000: "name", 1001: "version", 1002: "release", 1004: "summary", 1005: "description", 1009: "size", 1014: "license", 1015: "packager", 1016: "group", 1020: "homepage"}


@register("application/x-rpm", ".rpm")
def rpm(data: bytes) -> Extracted:
    """The main header, behind the lead and the signature."""
    if data[:4] != b"\xed\xab\xee\xdb":
        raise ValueError("no package")

    def header(at: int) -> tuple[dict[str, object], int]:
        if data[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("no header")
        n, size = struct.unpack(">II", data[at + 8 : at + 16])
        store, found = at + 16 + 16 * n, {}
        for k in range(n):
            tag, kind, offset, _ = struct.unpack(">IIII", data[at + 16 + 16 * k : at + 32 + 16 * k])
            if tag in _RPM and kind in (6, 8, 9):
                found[_RPM[tag]] = data[store + offset :].split(b"\0", 1)[0].decode("utf-8", "replace")
            elif tag in _RPM and kind == 4:
                found[_RPM[tag]] = struct.unpack(">I", data[store + offset : store + offset + 4])[0]
        return found, store + size

    _, end = header(96)
    v, _ = header(end + -end % 8)
    return _package(v.get("name"), f"{v.get('version')}-{v.get('release')}", v.get("summary"), v.get("group"), {"dc:description": v.get("description"), "pkg:license": v.get("license"), "pkg:homepage": v.get("homepage"), "pkg:packager": v.get("packager"), "pkg:size": v.get("size")})


# --- sound and pictures ---------------------------------------------------------------------------------------------------

# Frames of tags, and keys of comments, and the properties they are.
_ID3 = {"TIT2": "dc:title", "TPE1": "fixme:artist", "TALB": "fixme:album", "TRCK": "fixme:tracknumber", "TYER": "fixme:year", "TDRC": "fixme:year", "TCON": "fixme:genre", "COMM": "fixme:comment", "TT2": "dc:title", "TP1": "fixme:artist", "TAL": "fixme:album"}
_VORBIS = {"title": "dc:title", "artist": "fixme:artist", "album": "fixme:album", "tracknumber": "fixme:tracknumber", "date": "fixme:year", "genre": "fixme:genre", "comment": "fixme:comment", "description": "fixme:comment"}


def _tag(found: Extracted, key: str, value: str) -> None:
    found.add("k" if key in ("fixme:genre", "fixme:year", "fixme:tracknumber") else "t", key, value.strip("\0 "))


def _comments(found: Extracted, data: bytes) -> None:
    """Comments as Ogg and FLAC files have them: a maker, a number, and so many key=value texts."""
    size = struct.unpack("<I", data[:4])[0]
    n, at = struct.unpack("<I", data[4 + size : 8 + size])[0], 8 + size
    for _ in range(n):
        size = struct.unpack("<I", data[at : at + 4])[0]
        key, _, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if key.lower() in _VORBIS:
            _tag(found, _VORBIS[key.lower()], value)
        at += 4 + size


@register("audio/mpeg", "audio/x-mp3", "audio/ogg", "audio/x-vorbis+ogg", "application/ogg", "audio/x-flac", "audio/flac", ".mp3", ".ogg", ".oga", ".flac")
def audio(data: bytes) -> Extracted:
    found = Extracted("audio")
    if data[:3] == b"ID3":
        wide = data[3] >= 3
        size = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
        at, head, names = 10, 10 if wide else 6, 4 if wide else 3
        while at + head < 10 + size and data[at : at + names].isalnum():
            name = data[at : at + names].decode("latin-1")
            raw = data[at + names : at + names + (4 if wide else 3)]
            n = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(raw)) if data[3] == 4 else int.from_bytes(raw, "big")
            body = data[at + head : at + head + n]
            if name in _ID3 and body:
                encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[4 if name == "COMM" else 1 :].decode(encoding, "replace")
                _tag(found, _ID3[name], text.split("\0")[-1] if name == "COMM" else text)
            at += head + n
    elif data[:4] == b"fLaC":
        at, last = 4, False
        while not last and at + 4 <= len(data):
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            if kind == 4:
                _comments(found, data[at + 4 : at + 4 + size])
            at += 4 + size
    elif data[:4] == b"OggS":
        at = data.find(b"\x03vorbis")
        if at >= 0:
            _comments(found, data[at + 7 :])
    if data[-128:-125] == b"TAG" and not found.properties:
        for key, a, b in (("dc:title", 3, 33), ("fixme:artist", 33, 63), ("fixme:album", 63, 93), ("fixme:year", 93, 97), ("fixme:comment", 97, 127)):
            _tag(found, key, data[-128:][a:b].decode("latin-1"))
    return found


@register("video/x-msvideo", "video/avi", "video/mp4", "video/quicktime", ".avi", ".mp4", ".mov", ".m4v")
def video(data: bytes) -> Extracted:
    """Width, height and seconds from the file's own headers."""
    if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        at = data.index(b"avih") + 8
        frame_time, frames = struct.unpack("<I", data[at : at + 4])[0], struct.unpack("<I", data[at + 16 : at + 20])[0]
        width, height = struct.unpack("<II", data[at + 32 : at + 40])
        seconds = frame_time * frames // 1_000_000
    elif data[4:8] in (b"ftyp", b"moov", b"mdat", b"free"):
        at = data.index(b"mvhd") + 4
        long = data[at] == 1
        scale, length = struct.unpack(">IQ", data[at + 20 : at + 32]) if long else struct.unpack(">II", data[at + 12 : at + 20])
        seconds, width, height = length // max(1, scale), 0, 0
        for m in re.finditer(rb"tkhd", data):
            end = m.end() + (96 if data[m.end()] == 1 else 84)
            w, h = struct.unpack(">II", data[end - 8 : end])
            width, height = max(width, w >> 16), max(height, h >> 16)
    else:
        raise ValueError("no video that is known")
    found = Extracted("video")
    for k, v in {"fixme:video.width": width, "fixme:video.height": height, "fixme:duration": seconds}.items():
        found.add("k", k, v)
    return found


@register("image/tiff", ".tif", ".tiff")
def tiff(data: bytes) -> Extracted:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    values: dict[int, object] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        e = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", e[:8])
        if kind == 3:
            values[tag] = struct.unpack(order + "H", e[8:10])[0]
        elif kind == 4:
            values[tag] = struct.unpack(order + "I", e[8:12])[0]
        elif kind == 2:
            where = struct.unpack(order + "I", e[8:12])[0]
            values[tag] = (e[8 : 8 + n] if n <= 4 else data[where : where + n]).split(b"\0")[0].decode("latin-1")
    found = _image(values.get(256, 0), values.get(257, 0), **{"fixme:depth": values.get(258)})
    for tag, key in ((270, "exif:ImageDescription"), (271, "exif:Make"), (272, "exif:Model"), (305, "exif:Software"), (306, "exif:DateTime"), (315, "exif:Artist")):
        found.add("t", key, values.get(tag))
    return found


# --- documents ----------------------------------------------------------------------------------------------------------


def _pdf_text(body: bytes) -> str:
    """The texts that a page's instructions show."""
    out = []
    for m in re.finditer(rb"\((?P<text>(?:[^()\\]|\\.|\([^()]*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]+)>(?!>)|(?P<space>\bT[dDm*]|\bET|'|\")|(?P<gap>-\d{3,})", body):
        if m["text"] is not None:
            raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1][:1].isdigit() else {b"n": b"\n", b"r": b"", b"t": b" "}.get(x[1], x[1]), m["text"], flags=re.S)
            out.append(raw.decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))
        elif m["hex"] is not None:
            raw = bytes.fromhex(re.sub(r"\s", "", m["hex"].decode()).ljust(2, "0")) if len(re.sub(rb"\s", b"", m["hex"])) % 2 == 0 else b""
            out.append(raw.decode("utf-16-be", "ignore") if len(raw) > 1 and raw[0] == 0 else raw.decode("latin-1"))
        elif m["space"]:
            out.append("\n")
        else:
            out.append(" ")
    return re.sub(r"\n{2,}", "\n", "".join(out))


@register("application/pdf", "application/x-pdf", ".pdf")
def pdf(data: bytes) -> Extracted:
    """Text of pages whose fonts have plain encodings, and the information dictionary. Encrypted files give nothing."""
    if data[:5] != b"%PDF-":
        raise ValueError("no PDF")
    found, texts = Extracted(), []
    if b"/Encrypt" in data[-4096:]:
        raise ValueError("an encrypted PDF")
    for m in re.finditer(rb"<<(?P<dict>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end]
        if b"FlateDecode" in m["dict"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if re.search(rb"\bBT\b", body) and re.search(rb"\bT[jJ]\b|['\"]\s", body):
            texts += [_pdf_text(t) for t in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S)]
    for key, name in ((b"Title", "dc:title"), (b"Author", "dc:author"), (b"Subject", "dc:subject"), (b"Keywords", "dc:keyword"), (b"Creator", "dc:creator")):
        m = re.search(rb"/" + key + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f]+>)", data)
        found.add("t", name, _pdf_text(m[1]).strip() if m else None)
    found.add("k", "fixme:page-count", len(re.findall(rb"/Type\s*/Page\b", data)) or None)
    found.text = "\n".join(t.strip() for t in texts if t.strip())
    return found


_SECTOR_END = 0xFFFFFFFE


def _ole(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("no compound file")
    size, small = 1 << struct.unpack("<H", data[30:32])[0], 1 << struct.unpack("<H", data[32:34])[0]
    first_dir, cutoff, first_small, more, n_more = (struct.unpack("<I", data[k : k + 4])[0] for k in (48, 56, 60, 68, 72))
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    heads = [x for x in struct.unpack("<109I", data[76:512]) if x < _SECTOR_END - 3]
    while n_more and more < _SECTOR_END - 3:
        part = struct.unpack(f"<{size // 4}I", sector(more))
        heads += [x for x in part[:-1] if x < _SECTOR_END - 3]
        more, n_more = part[-1], n_more - 1
    table = [x for h in heads for x in struct.unpack(f"<{size // 4}I", sector(h).ljust(size, b"\xff"))]

    def chain(k: int, fat: list[int], read) -> bytes:
        out, met = [], set()
        while k < len(fat) and k not in met:
            met.add(k)
            out.append(read(k))
            k = fat[k]
        return b"".join(out)

    directory = chain(first_dir, table, sector)
    small_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw)) if (raw := chain(first_small, table, sector)) else []
    found, mini = {}, b""
    for k in range(0, len(directory) - 127, 128):
        e = directory[k : k + 128]
        name = e[: max(0, struct.unpack("<H", e[64:66])[0] - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack("<I", e[116:120])[0], struct.unpack("<I", e[120:124])[0]
        if e[66] == 5:
            mini = chain(start, table, sector)
        elif e[66] == 2:
            if length < cutoff:
                found[name] = chain(start, small_fat, lambda k: mini[k * small : (k + 1) * small])[:length]
            else:
                found[name] = chain(start, table, sector)[:length]
    return found


# The properties of a summary.
_SUMMARY = {2: "dc:title", 3: "dc:subject", 4: "dc:author", 5: "dc:keyword", 6: "dc:description"}


def _summary(found: Extracted, streams: dict[str, bytes]) -> None:
    raw = streams.get("\x05SummaryInformation", b"")
    if len(raw) < 48:
        return
    at = struct.unpack("<I", raw[44:48])[0]
    for k in range(struct.unpack("<I", raw[at + 4 : at + 8])[0]):
        key, offset = struct.unpack("<II", raw[at + 8 + 8 * k : at + 16 + 8 * k])
        kind, n = struct.unpack("<II", raw[at + offset : at + offset + 8])
        if key in _SUMMARY and kind == 30:
            found.add("t", _SUMMARY[key], raw[at + offset + 8 : at + offset + 8 + n].split(b"\0")[0].decode("cp1252", "replace"))


@register("application/msword", "application/vnd.ms-word", ".doc")
def word(data: bytes) -> Extracted:
    """The text of a Word file by its table of pieces."""
    streams, found = _ole(data), Extracted()
    _summary(found, streams)
    main = streams["WordDocument"]
    table = streams["1Table" if struct.unpack("<H", main[10:12])[0] & 0x200 else "0Table"]
    at, size = struct.unpack("<II", main[0x1A2:0x1AA])
    pieces, k = table[at : at + size], 0
    while pieces[k : k + 1] == b"\x01":
        k += 3 + struct.unpack("<H", pieces[k + 1 : k + 3])[0]
    n = (struct.unpack("<I", pieces[k + 1 : k + 5])[0] - 4) // 12
    ends = struct.unpack(f"<{n + 1}I", pieces[k + 5 : k + 9 + 4 * n])
    out = []
    for j in range(n):
        where = struct.unpack("<I", pieces[k + 9 + 4 * n + 8 * j + 2 : k + 9 + 4 * n + 8 * j + 6])[0]
        count = ends[j + 1] - ends[j]
        if where & 0x40000000:
            where = (where & 0x3FFFFFFF) // 2
            out.append(main[where : where + count].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * count].decode("utf-16-le", "replace"))
    found.text = re.sub(r"[\x07\x0b-\x0d]", "\n", re.sub(r"\x13[^\x14\x15]*\x14?|\x15", "", "".join(out))).translate({k: None for k in range(32) if k not in (9, 10)})
    return found


@register("application/vnd.ms-powerpoint", "application/mspowerpoint", ".ppt")
def slides(data: bytes) -> Extracted:
    """The text records of a presentation."""
    streams, found = _ole(data), Extracted()
    _summary(found, streams)
    body, out = streams["PowerPoint Document"], []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            version, kind, size = struct.unpack("<HHI", body[at : at + 8])
            if version & 15 == 15:
                walk(at + 8, min(end, at + 8 + size))
            elif kind == 4000:
                out.append(body[at + 8 : at + 8 + size].decode("utf-16-le", "replace"))
            elif kind == 4008:
                out.append(body[at + 8 : at + 8 + size].decode("cp1252", "replace"))
            at += 8 + size

    walk(0, len(body))
    found.text = "\n".join(x.replace("\r", "\n").replace("\x0b", "\n") for x in out)
    return found


@register("application/x-ole-document", "application/vnd.ms-office")
def compound(data: bytes) -> Extracted:
    found = Extracted()
    _summary(found, _ole(data))
    return found


@register("text/x-texinfo", ".texi", ".texinfo")
def texinfo(data: bytes) -> Extracted:
    text, found = re.sub(r"(?m)^@c(?:omment)?\b.*$", "", _str(data)), Extracted("documentation")
    for key, name in (("settitle", "dc:title"), ("title", "dc:title"), ("author", "dc:author")):
        m = re.search(rf"(?m)^@{key}\s+(.+)$", text)
        if m and not any(k == name for _, k, _ in found.properties):
            found.add("t", name, m[1].strip())
    text = re.sub(r"(?m)^@(?:end|ignore|menu|node|include|set|clear|setfilename|bye)\b.*$", "", text)
    text = re.sub(r"@\w+\{([^{}]*)\}", r"\1", re.sub(r"@\w+\{([^{}]*)\}", r"\1", text))
    found.text = re.sub(r"\n{2,}", "\n", re.sub(r"@(\w+)[ \t]?|@([@{}])", lambda m: m[2] or "", text)).strip()
    return found


@register("text/x-info", "application/x-info", ".info")
def info(data: bytes) -> Extracted:
    """Nodes without their headers and menus."""
    text, found = _str(data), Extracted("documentation")
    m = re.search(r"(?m)^\* ([^:(]+): \(", text)
    found.add("t", "dc:title", m and m[1].strip())
    nodes = re.split(r"\x1f\n?", text)
    kept = [re.sub(r"(?m)^File: .*$|^\* Menu:.*$|^\*{2,}$|^={2,}$|^-{2,}$", "", n) for n in nodes if not re.match(r"(?:Tag Table|End Tag Table|Indirect|Local Variables)", n)]
    found.text = "\n".join(x.strip() for x in "\n".join(kept).split("\n") if x.strip())
    return found


# --- chat logs and mailboxes -----------------------------------------------------------------------------------------------


def _talk(lines: list[tuple[str, str, str]], protocol: str) -> Extracted:
    """A conversation of (time, speaker, text)."""
    found = Extracted("conversation")
    found.add("k", "fixme:protocol", protocol)
    for who in dict.fromkeys(w for _, w, _ in lines if w):
        found.add("k", "fixme:speaker", who)
    if lines:
        found.add("k", "fixme:starttime", lines[0][0])
        found.add("k", "fixme:endtime", lines[-1][0])
    found.text = "\n".join(t for _, _, t in lines)
    return found


@register("siftwell/x-pidgin-log")
def pidgin(data: bytes) -> Extracted:
    """A log of text lines or of HTML: (time) speaker: words."""
    text = _str(data)
    if text.lstrip()[:1] == "<":
        text = page(re.sub(rb"(?i)<br\s*/?>", b"<p>", data)).text
    found = re.findall(r"(?m)^\s*\(([^)]*\d:\d\d[^)]*)\)\s*([^:\n]+):\s*(.*)$", text)
    m = re.search(r"(?i)conversation with (\S+).*?\bon (\S+)", text)
    talk = _talk(found, "pidgin")
    if m:
        talk.add("k", "fixme:speakingto", m[1])
        talk.add("k", "fixme:identity", m[2])
    return talk


@register("siftwell/x-kopete-log")
def kopete(data: bytes) -> Extracted:
    root = ElementTree.fromstring(data)
    lines = [(e.get("time", ""), e.get("nick") or e.get("from", ""), "".join(e.itertext()).strip()) for e in root.iter("msg")]
    talk = _talk(lines, "kopete")
    for e in root.iter("contact"):
        if e.get("type") != "myself":
            talk.add("k", "fixme:speakingto", e.get("contactId"))
    return talk


@register("siftwell/x-empathy-log")
def empathy(data: bytes) -> Extracted:
    root = ElementTree.fromstring(data)
    lines = [(e.get("time", ""), e.get("name") or e.get("id", ""), "".join(e.itertext()).strip()) for e in root.iter("message")]
    talk = _talk(lines, "empathy")
    for who in dict.fromkeys(e.get("id") for e in root.iter("message") if e.get("isuser") == "false"):
        talk.add("k", "fixme:speakingto", who)
    return talk


@register("siftwell/x-konversation-log")
def irc(data: bytes) -> Extracted:
    """[day] [time] <speaker> words."""
    found = re.findall(r"(?m)^\[([^\]]*)\] \[([^\]]*)\] <([^>]+)>\t?\s?(.*)$", _str(data))
    return _talk([(f"{d} {t}", who, words) for d, t, who, words in found], "irc")


@register("siftwell/x-labyrinth-map")
def labyrinth(data: bytes) -> Extracted:
    root, found = ElementTree.fromstring(data), Extracted("note")
    found.add("t", "dc:title", root.get("title"))
    found.text = "\n".join(x.strip() for e in root.iter() if e.tag.endswith("thought") for x in [e.text or ""] if x.strip())
    return found


@register("siftwell/x-konq-history")
def browsed(data: bytes) -> Extracted:
    """A cached page behind the lines that say where it is from."""
    head, _, body = data.partition(b"\n\n") if b"\n\n" in data[:4096] else (b"", b"", data)
    found = page(body)
    m = re.search(r"(?m)^(https?://\S+)", _str(head))
    found.add("k", "fixme:host", m and re.sub(r"^https?://([^/:]+).*$", r"\1", m[1]))
    return found


@register("application/mbox", "application/x-mbox", ".mbox")
def mails(data: bytes) -> Extracted:
    """A mailbox: each mail is a child."""
    found = Extracted("mailbox")
    with tempfile.NamedTemporaryFile(suffix=".mbox") as f:  # the library reads by path; it is gone with the call
        f.write(data)
        f.flush()
        box = mailbox.mbox(f.name)
        for key in box.keys():
            raw = box.get_bytes(key)
            m = re.search(rb"(?im)^message-id:\s*<?([^>\r\n]+)", raw)
            found.children.append((m[1].decode("latin-1").strip() if m else str(key), "message/rfc822", raw))
        box.close()
    return found


def hot_text(data: bytes) -> str:
    """The words of a page that its author stresses: headings, bold, italic, strong and emphasised ones."""
    return " ".join(page(x.encode()).text for x in re.findall(r"(?is)<(?:h[1-6]|b|i|strong|em|u|big)\b[^>]*>(.*?)</(?:h[1-6]|b|i|strong|em|u|big)>", _str(data)))


def register_program(kind: str, command: str, timeout: float = 60.0) -> None:
    """Have files of a mime type, or an extension, read by a program: %s is the file, what it prints is the text."""

    @register(kind)
    def run(data: bytes) -> Extracted:
        with tempfile.NamedTemporaryFile() as f:
            f.write(data)
            f.flush()
            done = subprocess.run([x.replace("%s", f.name) for x in shlex.split(command)], capture_output=True, timeout=timeout, check=True)
        return Extracted(text=done.stdout.decode("utf-8", "replace"))


def sniffed(data: bytes) -> str | None:
    """The mime type that a file's first bytes tell, of those that can be read."""
    for magic, kind in (
        (b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"),
        (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"BZh", "application/x-bzip2"), (b"{\\rtf", "application/rtf"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"),
        (b"!<arch>\ndebian", "application/x-deb"), (b"\xed\xab\xee\xdb", "application/x-rpm"), (b"\xd0\xcf\x11\xe0", "application/vnd.ms-office"), (b"From ", "application/mbox"), (b"<?xml", "text/xml"), (b"#!", "application/x-shellscript"),
    ):
        if data.startswith(magic):
            return kind
    head = data[:512].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    if re.match(rb"(?:received|return-path|from|date|message-id|subject):\s", head):
        return "message/rfc822"
    return "text/plain" if data and b"\0" not in data[:512] else None


__all__ = ["audio", "hot_text", "mail", "register_program", "sniffed"]

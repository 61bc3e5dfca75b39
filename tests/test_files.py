import io
import struct
import zipfile

from siftwell.plans import xmlquery
from siftwell.plans.parts import PROHIBITED, And, DateRange, Or, Property, Text
from siftwell.sources import files


def test_formats():
    html = files.page(b'<html><head><title>A &amp; B</title><meta name="Robots" content="none"></head><body><h1>Hi</h1><script>x("<p>")</script>see <a href="http://x.org/a%20b">this</a></body></html>')
    assert html.properties == [("t", "meta:robots", "none"), ("t", "dc:title", "A & B")] and html.links == ["http://x.org/a%20b"] and html.text == "Hi\nsee http://x.org/a b this"
    source = files.BY_TYPE["text/x-python"](b'import os  # a comment\ndef f():\n    """Doc of f"""\n    return "a string"\n')
    assert source.text.split("\n") == ["import os def f return", "a comment", "Doc of f", "a string"]
    assert files.rich_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}{\info{\title T}}Hello \b World\b0\par caf\'e9 \u233?}").text.startswith("Hello World\ncafé é")
    assert files.png(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIB", 13, b"IHDR", 30, 40, 8) + bytes(8)).properties[:2] == [("k", "fixme:width", "30"), ("k", "fixme:height", "40")]
    assert files.playlist(b"#EXTM3U\n#EXTINF:12,A song\n/m/a.mp3\n").text == "A song\n/m/a.mp3"
    assert ("t", "fixme:name", "Web") in files.desktop(b"[Desktop Entry]\nName=Web\nName[de]=Netz\nExec=web %u\n").properties
    assert files.calendar(b"BEGIN:VCARD\nFN:Jo\n  e\nEMAIL;TYPE=x:j@e.org\n").properties == [("t", "vCard:FN", "Jo e"), ("t", "vCard:EMAIL", "j@e.org")]


def test_mail_with_attachment():
    text = b"From: Jo <jo@x.org>\nTo: b@x.org\nSubject: Hey\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nMessage-ID: <1@x>\nIn-Reply-To: <0@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nbody\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\ninside\n--B--\n"
    rows = list(files.rows_of("m.eml", None, text))
    found = {(p["key"], p["value"]) for p in rows[0][5]}
    assert {("dc:title", "Hey"), ("fixme:date", "20240101100000"), ("fixme:from_address", "jo@x.org"), ("fixme:from_name", "Jo"), ("fixme:msgid", "1@x"), ("fixme:reference", "0@x"), ("fixme:hasAttachments", "true")} <= found
    assert rows[1][:2] == ("m.eml#a.txt", "m.eml") and rows[1][4].strip() == "inside"


def test_folder(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("one.txt", "first")
        z.writestr("sub/two.html", "<p>second</p>")
    (tmp_path / "a.zip").write_bytes(inner.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    got = {r["path"].rpartition("/")[2] if "#" not in r["path"] else r["path"].partition("#")[2]: r for r in files.read(spark, str(tmp_path)).collect()}
    assert got["one.txt"]["text"] == "first" and got["sub/two.html"]["text"] == "second" and got["one.txt"]["parent_uri"].endswith("a.zip")
    assert got["bad.zip"]["error"] and got["bad.zip"]["text"] == ""


def test_xml_queries():
    query = xmlquery.parse('<request><query><and><fullText><string>word</string></fullText><equals negate="true"><field name="dc:title"/><string>x</string></equals><or><lessThan><field name="dc:date"/><date>2024-01-02</date></lessThan><inSet><field name="dc:language"/><string>de</string><string>fr</string></inSet></or></and></query></request>')
    (both,) = query.parts
    assert isinstance(both, And) and both.parts[0] == Text("word") and both.parts[1] == Property("t", "dc:title", "x", logic=PROHIBITED)
    assert isinstance(both.parts[2], Or) and both.parts[2].parts[0].start is None and both.parts[2].parts[1] == Or([Property("k", "dc:language", "de"), Property("k", "dc:language", "fr")])
    strict = xmlquery.parse('<query><lessThan><field name="dc:date"/><date>20240102</date></lessThan></query>', strict=True).parts[0]
    assert isinstance(strict, DateRange) and strict.end is None

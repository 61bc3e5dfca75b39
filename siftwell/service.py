"""Requests and responses of the engine as a service: objects, their XML, and a server over HTTP or a local socket.

A request is one element; its answer is a list of responses. A query's hits go out in messages of BATCH, followed by what
says that it is finished; it stays registered, so that later changes are told as hits added and subtracted, until
it is taken back.
"""

from __future__ import annotations

import os
import socketserver
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.engine import Engine
from siftwell.operators.index import Index
from siftwell.plans import human
from siftwell.sources import registry

VERSION = "2"
BATCH = 25


@dataclass
class Message:
    """A request or response: its name is its class's, its fields are attributes and lists."""

    def xml(self) -> str:
        plain, inner = "", ""
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, list):
                inner += "".join(f"<{f.name}>" + (escape(x) if isinstance(x, str) else "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in x.items())) + f"</{f.name}>" for x in value)
            elif value is not None:
                plain += f" {f.name}={quoteattr(str(value))}"
        return f"<{type(self).__name__}{plain}>{inner}</{type(self).__name__}>"


def _message(name: str, **kinds) -> type[Message]:
    return dataclass(type(name, (Message,), {"__annotations__": kinds, **{k: field(default_factory=list) if v is list else None for k, v in kinds.items()}}))


# Requests.
QueryRequest = _message("QueryRequest", text=str, max_hits=int, scope=str, listener=str)
CountMatchRequest = _message("CountMatchRequest", text=str, scope=str)
StopQueryRequest = _message("StopQueryRequest", id=int)
SnippetRequest = _message("SnippetRequest", text=str, uri=list)
IndexingServiceRequest = _message("IndexingServiceRequest", add=list, remove=list)
InformationalMessagesRequest = _message("InformationalMessagesRequest")
DaemonInformationRequest = _message("DaemonInformationRequest")
ShutdownRequest = _message("ShutdownRequest")
ReloadConfigRequest = _message("ReloadConfigRequest")
OptimizeIndexesRequest = _message("OptimizeIndexesRequest")
RemovableIndexRequest = _message("RemovableIndexRequest", path=str, mount=str)
RemoteIndexerRequest = _message("RemoteIndexerRequest", source=str, path=str)
RDFQueryRequest = _message("RDFQueryRequest", subject=str, predicate=str, object=str)
REQUESTS = {c.__name__: c for c in (QueryRequest, CountMatchRequest, StopQueryRequest, SnippetRequest, IndexingServiceRequest, InformationalMessagesRequest, DaemonInformationRequest, ShutdownRequest, ReloadConfigRequest, OptimizeIndexesRequest, RemovableIndexRequest, RemoteIndexerRequest, RDFQueryRequest)}

# Responses.
HitsAddedResponse = _message("HitsAddedResponse", id=int, total=int, hit=list)
HitsSubtractedResponse = _message("HitsSubtractedResponse", id=int, uri=list)
FinishedResponse = _message("FinishedResponse", id=int)
SearchTermResponse = _message("SearchTermResponse", id=int, term=list)
CountMatchResponse = _message("CountMatchResponse", count=int)
SnippetResponse = _message("SnippetResponse", snippet=list)
IndexingStatusResponse = _message("IndexingStatusResponse", state=str, message=str)
DaemonInformationResponse = _message("DaemonInformationResponse", version=str, documents=int, indexing=str, source=list)
RemovableIndexResponse = _message("RemovableIndexResponse", mounted=str, documents=int)
RemoteIndexerResponse = _message("RemoteIndexerResponse", documents=int)
RDFQueryResult = _message("RDFQueryResult", triple=list)
EmptyResponse = _message("EmptyResponse")
ErrorResponse = _message("ErrorResponse", message=str, details=str)


def parse(xml: str) -> Message:
    e = ElementTree.fromstring(xml)
    if e.tag not in REQUESTS:
        raise ValueError(f"no such request: {e.tag}")
    cls = REQUESTS[e.tag]
    values: dict = {}
    for f in fields(cls):
        if any(c.tag == f.name for c in e):
            values[f.name] = [(c.text or "") if not len(c) else {g.tag: g.text or "" for g in c} for c in e if c.tag == f.name]
        elif f.name in e.attrib:
            values[f.name] = e.attrib[f.name]
    return cls(**values)


class Service:
    """Answers requests on one index and the removable ones that are mounted."""

    def __init__(self, index: Index, reload: Callable[[], None] | None = None) -> None:
        self.index, self.reload = index, reload
        self.running, self.state, self.begun = True, "idle", time.time()
        self.live: dict[int, dict] = {}
        self.mounted: dict[str, DataFrame] = {}
        self.lock = threading.Lock()
        self.numbers = 0

    def engine(self) -> Engine:
        docs = self.index.documents()
        for more in self.mounted.values():
            docs = docs.unionByName(more.select(*docs.columns))
        return Engine(docs, self.index.analyzer)

    def handle(self, request: Message) -> list[Message]:
        """The responses to a request; a problem becomes one of them."""
        try:
            return list(getattr(self, "_" + type(request).__name__)(request))
        except Exception as e:  # told to the client, as the service goes on
            return [ErrorResponse(message=str(e).split("\n")[0], details=type(e).__name__)]

    def answer(self, xml: str) -> str:
        try:
            found = self.handle(parse(xml))
        except (ValueError, ElementTree.ParseError) as e:
            found = [ErrorResponse(message=str(e), details=type(e).__name__)]
        return "<responses>" + "".join(r.xml() for r in found) + "</responses>"

    def _QueryRequest(self, r) -> Iterator[Message]:
        with self.lock:
            self.numbers += 1
            number = self.numbers
        engine, most = self.engine(), int(r.max_hits or 100)
        query = human.parse(r.text or "")
        listener = str(r.listener).lower() == "true"
        found = [] if listener else engine.search(query, most, r.scope, per_source=False).select("uri", "ts", "source", "score").limit(most).collect()  # a message's hits
        self.live[number] = {"query": query, "listener": listener, "known": {h["uri"] for h in found}}
        yield SearchTermResponse(id=number, term=human.search_terms(query, engine.analyzer.terms))
        if not listener:
            total = engine.matches(query, r.scope).count()
            for k in range(0, len(found), BATCH):
                yield HitsAddedResponse(id=number, total=total, hit=[{"uri": h["uri"], "timestamp": h["ts"] or "", "source": h["source"] or "", "score": h["score"]} for h in found[k : k + BATCH]])
        yield FinishedResponse(id=number)

    def _StopQueryRequest(self, r) -> Iterator[Message]:
        self.live.pop(int(r.id), None)
        yield EmptyResponse()

    def changed(self, added: DataFrame, removed: DataFrame | None = None) -> list[Message]:
        """What a change of documents is to the registered queries: known hits are subtracted, then matching ones added."""
        out: list[Message] = []
        touched = added.select("uri") if removed is None else added.select("uri").union(removed.select("uri"))
        uris = {r["uri"] for r in touched.collect()}  # a batch of changes, as a client sends it
        for number, live in list(self.live.items()):
            gone = sorted(live["known"] & uris)
            hits = added if live["listener"] else Engine(added, self.index.analyzer).matches(live["query"])
            new = sorted(r["uri"] for r in hits.select("uri").distinct().collect())
            live["known"] = live["known"] - uris | set(new)
            if gone:
                out.append(HitsSubtractedResponse(id=number, uri=gone))
            if new:
                out.append(HitsAddedResponse(id=number, total=len(new), hit=[{"uri": u} for u in new]))
        return out

    def _CountMatchRequest(self, r) -> Iterator[Message]:
        yield CountMatchResponse(count=self.engine().count(r.text or "", r.scope))

    def _SnippetRequest(self, r) -> Iterator[Message]:
        engine = self.engine()
        hits = engine.docs.where(F.col("uri").isin(r.uri))
        found = engine.snippets(hits, r.text or "").collect()
        yield SnippetResponse(snippet=[{"uri": s["uri"], "text": " ... ".join("".join(f["text"] for f in line["fragments"]) for line in s["snippet"])} for s in found])

    def _IndexingServiceRequest(self, r) -> Iterator[Message]:
        spark = self.index.spark
        self.state = "indexing"
        try:
            columns = self.index.documents().schema
            removed = spark.createDataFrame([(u,) for u in r.remove], "uri string")
            rows = [tuple(x.get(f.name) if f.name in ("uri", "parent_uri", "source", "hit_type", "mime_type", "text") else [] if f.name == "properties" else None for f in columns) for x in r.add]
            added = spark.createDataFrame(rows, columns).withColumn("domain", F.lit(1)) if rows else spark.createDataFrame([], columns)
            self.index.delete(removed.union(added.select("uri")))
            if rows:
                self.index.add(added, 1)
            yield from self.changed(added, removed)
        finally:
            self.state = "idle"
        yield EmptyResponse()

    def _InformationalMessagesRequest(self, r) -> Iterator[Message]:
        yield IndexingStatusResponse(state=self.state, message=f"{len(self.live)} queries are registered")

    def _DaemonInformationRequest(self, r) -> Iterator[Message]:
        sources = self.engine().info().collect()  # a row for each source
        yield DaemonInformationResponse(version=VERSION, documents=sum(s["n"] for s in sources), indexing=self.state, source=[{"name": s["source"] or "", "documents": s["n"]} for s in sources])

    def _ShutdownRequest(self, r) -> Iterator[Message]:
        self.running = False
        yield EmptyResponse()

    def _ReloadConfigRequest(self, r) -> Iterator[Message]:
        if self.reload:
            self.reload()
        yield EmptyResponse()

    def _OptimizeIndexesRequest(self, r) -> Iterator[Message]:
        self.state = "optimizing"
        try:
            self.index.optimize()
        finally:
            self.state = "idle"
        yield EmptyResponse()

    def _RemovableIndexRequest(self, r) -> Iterator[Message]:
        if not r.mount:
            self.mounted.pop(r.path, None)
            yield RemovableIndexResponse(mounted="false", documents=0)
            return
        other = Index(self.index.spark, r.path, self.index.analyzer).documents()
        self.mounted[r.path] = registry.rebased(other, r.mount)
        yield RemovableIndexResponse(mounted="true", documents=other.count())

    def _RemoteIndexerRequest(self, r) -> Iterator[Message]:
        docs = registry.SOURCES[r.source].load(self.index.spark, r.path).select(*self.index.documents().columns)
        self.index.update(docs)
        yield RemoteIndexerResponse(documents=docs.count())

    def _RDFQueryRequest(self, r) -> Iterator[Message]:
        from siftwell.operators import triples

        found = triples.select(triples.of_documents(self.engine().docs), r.subject, r.predicate, r.object)
        yield RDFQueryResult(triple=[t.asDict() for t in found.toLocalIterator()])


def http_server(service: Service, port: int = 0, pages: str | None = None) -> HTTPServer:
    """POST / takes a request's XML; GET gives the files of a folder of pages, if there is one."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes, kind: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode("utf-8")
            self._send(200, service.answer(body).encode("utf-8"), "text/xml; charset=utf-8")
            if not service.running:
                threading.Thread(target=self.server.shutdown).start()

        def do_GET(self) -> None:
            root = os.path.realpath(pages) if pages else ""
            at = os.path.realpath(os.path.join(root, self.path.lstrip("/") or "index.html"))
            if not pages or not at.startswith(root + os.sep) or not os.path.isfile(at):
                return self._send(404, b"not there", "text/plain")
            with open(at, "rb") as f:
                self._send(200, f.read(), "text/html; charset=utf-8" if at.endswith(".html") else "application/octet-stream")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def socket_server(service: Service, path: str) -> socketserver.UnixStreamServer:
    """A request's XML, ended by a byte of 0xFF, is answered likewise."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            data = b""
            while not data.endswith(b"\xff"):
                more = self.request.recv(65536)
                if not more:
                    return
                data += more
            self.wfile.write(service.answer(data[:-1].decode("utf-8")).encode("utf-8") + b"\xff")

    return socketserver.ThreadingUnixStreamServer(path, Handler)


def ask(address: str, request: Message) -> str:
    """The answer's XML of a service at http://host:port or at a socket's path."""
    if address.startswith("http://"):
        from urllib.request import Request, urlopen

        with urlopen(Request(address, request.xml().encode("utf-8"), method="POST")) as found:
            return found.read().decode("utf-8")
    import socket

    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.connect(address)
        s.sendall(request.xml().encode("utf-8") + b"\xff")
        data = b""
        while not data.endswith(b"\xff"):
            data += s.recv(65536)
        return data[:-1].decode("utf-8")

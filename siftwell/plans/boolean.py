"""The library's query syntax: AND OR NOT, grouping, fields, slop, fuzzy, boosts and ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from siftwell.plans.parts import PROHIBITED, REQUIRED, And, Fuzzy, Or, Part, Prefix, Property, Text, TermRange, Wildcard, rewritten

_LEX = re.compile(
    r"""\s*(?:(?P<op>&&|\|\||[()+!-])|(?P<field>[^\s:"()\[\]{}^~+!]+):|(?P<phrase>"(?:[^"\\]|\\.)*")(?:~(?P<slop>[0-9]+))?
    |(?P<range>[\[{]\s*\S+\s+TO\s+[^\s\]}]+\s*[\]}])|(?P<word>(?:[^\s:"()\[\]{}^~!]|\\.)+)(?P<fuzzy>~(?P<sim>[0-9.]+)?)?)(?:\^(?P<boost>[0-9.]+))?""",
    re.X,
)


@dataclass
class _Token:
    kind: str
    value: str
    extra: str | None = None
    boost: float = 1.0


class SyntaxProblem(ValueError):
    """The text isn't a query."""


def _lex(text: str) -> list[_Token]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise SyntaxProblem(f"unreadable at {at}: {text[at : at + 20]!r}")
        at = m.end()
        boost = float(m["boost"]) if m["boost"] else 1.0
        if m["op"]:
            out.append(_Token({"&&": "AND", "||": "OR", "!": "NOT"}.get(m["op"], m["op"]), m["op"], None, boost))
        elif m["field"] is not None:
            out.append(_Token("field", m["field"]))
        elif m["phrase"] is not None:
            out.append(_Token("phrase", m["phrase"][1:-1], m["slop"], boost))
        elif m["range"] is not None:
            out.append(_Token("range", m["range"], None, boost))
        elif m["word"] in ("AND", "OR", "NOT"):
            out.append(_Token(m["word"], m["word"]))
        else:
            out.append(_Token("fuzzy" if m["fuzzy"] else "word", m["word"], m["sim"], boost))
    return out


class _Parser:
    def __init__(self, text: str, default_and: bool, leading_wildcard: bool) -> None:
        self.tokens, self.at, self.default_and, self.leading = _lex(text), 0, default_and, leading_wildcard

    def _peek(self) -> str | None:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else None

    def _next(self) -> _Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def clauses(self, field: str | None) -> Part:
        """A run of clauses: (needed, part), by signs, AND, OR and NOT."""
        found: list[list] = []
        while self._peek() not in (None, ")"):
            joined = None
            if self._peek() in ("AND", "OR"):
                joined = self._next().kind
            sign = None
            while self._peek() in ("+", "-", "NOT"):
                sign = self._next().kind
            part = self.one(field)
            needed = "no" if sign in ("-", "NOT") else "yes" if sign == "+" or joined == "AND" or (self.default_and and joined != "OR") else "may"
            if joined == "AND" and found and found[-1][0] == "may":
                found[-1][0] = "yes"
            if joined == "OR" and self.default_and and found and found[-1][0] == "yes":
                found[-1][0] = "may"
            found.append([needed, part])
        if not found:
            raise SyntaxProblem("an empty query")
        must = [p for n, p in found if n == "yes"]
        may = [p for n, p in found if n == "may"]
        for p in must:
            p.logic = REQUIRED
        for n, p in found:
            if n == "no":
                p.logic = PROHIBITED
        never = [p for n, p in found if n == "no"]
        if not never and len(found) == 1:
            return found[0][1]
        return And([*must, *([Or(may)] if may and not must else []), *never])

    def one(self, field: str | None) -> Part:
        if self._peek() is None:
            raise SyntaxProblem("the query ends too soon")
        t = self._next()
        if t.kind == "field":
            return self.one(t.value)
        if t.kind == "(":
            part, t = self.clauses(field), None
            if self._peek() != ")":
                raise SyntaxProblem("a parenthesis isn't closed")
            part.boost *= self._next().boost
            return part
        part = self._leaf(t, field)
        part.boost = t.boost
        return part

    def _leaf(self, t: _Token, field: str | None) -> Part:
        if t.kind == "phrase":
            slop = int(t.extra or 0)
            return Property("t", field, t.value, slop=slop) if field else Text(t.value, slop=slop)
        if t.kind == "range":
            low, _, high = t.value[1:-1].strip().partition(" TO ")
            return TermRange(None if low.strip() == "*" else low.strip(), None if high.strip() == "*" else high.strip(), t.value[0] == "[", field)
        if t.kind == "fuzzy":
            return Fuzzy(t.value.lower(), float(t.extra) if t.extra else 0.5, key=field)
        if t.kind == "word":
            if t.value[0] in "*?" and not self.leading:
                raise SyntaxProblem("a wildcard can't come first")
            if field:
                return Property("t", field, t.value)
            if t.value.endswith("*") and not re.search(r"[*?]", t.value[:-1]):
                return Prefix(t.value[:-1].lower())
            return Wildcard(t.value) if re.search(r"[*?]", t.value) else Text(t.value)
        raise SyntaxProblem(f"{t.value!r} can't stand here")


def parse_fields(text: str, fields: list[str], default_and: bool = False) -> Part:
    """A query whose words without a field may be in any of several."""

    def spread(p: Part) -> Part | None:
        if isinstance(p, Text):
            return Or([Property("t", f, p.text, slop=p.slop, boost=p.boost) for f in fields])
        if isinstance(p, (Fuzzy, TermRange)) and p.key is None:
            return Or([replace(p, key=f) for f in fields])
        return None

    return rewritten(parse(text, default_and), spread)


def parse(text: str, default_and: bool = False, leading_wildcard: bool = False) -> Part:
    parser = _Parser(text, default_and, leading_wildcard)
    part = parser.clauses(None)
    if parser.at < len(parser.tokens):
        raise SyntaxProblem("too many closing parentheses")
    return part

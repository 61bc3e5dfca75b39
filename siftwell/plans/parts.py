"""Query trees."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

REQUIRED, PROHIBITED = "required", "prohibited"
LOCAL, SYSTEM, NEIGHBORHOOD, GLOBAL = 1, 2, 4, 8


@dataclass
class Part:
    logic: str = field(default=REQUIRED, kw_only=True)
    #: What its score is multiplied by.
    boost: float = field(default=1.0, kw_only=True)


@dataclass
class Text(Part):
    """A phrase in the text or the text properties, or the whole value of a keyword property."""

    text: str
    full_text: bool = field(default=True, kw_only=True)
    properties: bool = field(default=True, kw_only=True)
    slop: int = field(default=0, kw_only=True)


@dataclass
class Wildcard(Part):
    pattern: str


@dataclass
class Prefix(Part):
    prefix: str


@dataclass
class Fuzzy(Part):
    term: str
    similarity: float = 0.5
    prefix: int = 0
    key: str | None = None  # a text property instead of the text


@dataclass
class TermRange(Part):
    low: str | None
    high: str | None
    inclusive: bool = True
    key: str | None = None


@dataclass
class MultiPhrase(Part):
    """A phrase with several words to choose from at each place."""

    words: list[list[str]]


@dataclass
class Property(Part):
    kind: str  # t, k or d
    key: str  # or _all
    value: str
    slop: int = field(default=0, kw_only=True)


@dataclass
class DateRange(Part):
    start: datetime | None
    end: datetime | None
    key: str = "Timestamp"  # Timestamp, _all or a date property


@dataclass
class Uri(Part):
    uri: str


@dataclass
class Or(Part):
    parts: list[Part]
    least: int = 1


@dataclass
class And(Part):
    """Only for nested trees; the parts' own logic holds in it."""

    parts: list[Part]


@dataclass
class MatchAll(Part):
    pass


def rewritten(part: Part, hook: Callable[[Part], Part | None]) -> Part:
    """A tree in which a source's hook has put its own parts in place of others (None: it stays)."""
    found = hook(part)
    if found is not None:
        found.logic = part.logic
        return found
    if isinstance(part, Or):
        return replace(part, parts=[rewritten(p, hook) for p in part.parts])
    if isinstance(part, And):
        return replace(part, parts=[rewritten(p, hook) for p in part.parts])
    return part


@dataclass
class Query:
    parts: list[Part]
    domain: int = LOCAL | SYSTEM
    max_hits: int = 100
    extra: dict[str, Any] = field(default_factory=dict)

"""Snippets: the lines of a text around the words that match, taken after the top hits are chosen."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftwell.shipping import ship

CONTEXT, LENGTH = 6, 200
_WORD = re.compile(r"[^\W_]+")

SNIPPET = "array<struct<line:bigint,fragments:array<struct<term:int,text:string>>>>"


def snippet(text: str, terms: list[str], stem: Callable[[str], str] = str.lower, context: int = CONTEXT, length: int = LENGTH) -> list[dict]:
    """Fragments by line, each with the number of its term or -1.

    Words before a match are kept in a window of context words; a full window gives one word less. After a
    match, context words follow. No new line is taken once length is reached.
    """
    found, total = [], 0
    for number, line in enumerate(text.split("\n")):
        if total >= length:
            break
        fragments: list[dict] = []
        window: list[int] = []
        done, after = 0, -1
        for m in _WORD.finditer(line):
            word = m.group()
            term = next((k for k, t in enumerate(terms) if len(word) >= len(t) and stem(word.lower()).lower() == t.lower()), -1)
            if term < 0:
                if after >= 0:
                    after += 1
                    if after == context:
                        fragments.append({"term": -1, "text": line[done : m.end()]})
                        done, after = m.end(), -1
                        window = []
                        if total + sum(len(f["text"]) for f in fragments) >= length:
                            break
                else:
                    window = [*window, m.start()][-context:]
                continue
            if after >= 0:
                start = done
            elif not window:
                start = max(done, m.start())
            else:
                start = max(done, window[1] if len(window) == context else window[0])
            if start < m.start():
                fragments.append({"term": -1, "text": line[start : m.start()]})
            fragments.append({"term": term, "text": word})
            done, after, window = m.end(), 0, []
        if after >= 0:
            if done < len(line):
                fragments.append({"term": -1, "text": line[done:]})
        if fragments:
            total += sum(len(f["text"]) for f in fragments)
            found.append({"line": number, "fragments": fragments})
    return found


def snippets(text: Column, terms: list[str], context: int = CONTEXT, length: int = LENGTH) -> Column:
    ship(SparkSession.getActiveSession())

    @F.pandas_udf(SNIPPET)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: snippet(x or "", terms, context=context, length=length))

    return run(text)

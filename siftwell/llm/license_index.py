"""License scans by a positional index of rare template words.

Of each key phrase of a licence template, the word of the highest inverse document frequency over all
files is looked up in the templates' postings (word, place), wherever a file has it. (Files without any of the
ways in aren't counted; they have none of the words that can be looked up.) Each place in the
file less the place in the template is an offset, which aligns the template. The score is the share of the
template's words that stand where they should, or within DRIFT words of it, so that words may be put in or left out; a
template is found when the score reaches MIN_SCORE and one of its key phrases stands just where it should. An
alignment with a key phrase has that phrase's rarest word at its place, so none is missed, however many
notices a file holds.

Base places, where a fixed phrase's words stand consecutively, are found in every text besides and
give their labels whatever the templates say.

Hostile cases: a null text is an empty one, with no words; any number of places is kept; repeated rows
give repeated rows; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import LOWER, UPPER, written

#: What parts words: ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
EDGES = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Templates: label, the notice's words, key phrases of which one must be there.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by", "this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["general public license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["in no event will the authors be held liable"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
MIN_SCORE = 0.8
#: How far from its place a word of a template may stand.
DRIFT = 3
#: Template words that ordinary prose is full of; they count for the score but are no way in.
COMMON = {"the", "this", "is", "a", "of", "to", "and", "or", "in", "it", "any", "you", "can", "are", "with", "by", "under", "use", "work", "all", "person", "free", "into", "form", "forms", "public", "version", "code", "source", "0", "1", "2", "3", "4", "for", "all", "no", "not", "be", "will", "may", "use", "must", "have", "has", "or", "as", "at", "above", "following", "list", "related", "law", "author", "authors", "event", "possible", "purpose", "shall", "should", "available", "made", "file", "except", "along", "without", "received", "included", "provided", "extent"}


def _templates() -> list[list[str]]:
    return [t.split() for _, t, _ in TEMPLATES]


def vocabulary() -> list[str]:
    return sorted({w for t in _templates() for w in t})


def _key_spans(t: int) -> list[tuple[int, int]]:
    """Place and number of words of each key phrase of a template."""
    ws = TEMPLATES[t][1].split()
    return [(next(i for i in range(len(ws)) if ws[i : i + len(k.split())] == k.split()), len(k.split())) for k in TEMPLATES[t][2]]


def _phrase_words() -> set[str]:
    return {w for p in PHRASES for w in p.split()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and the words where a way in is among them (else null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.btrim(text, F.lit(EDGES)).alias("t"))
    ways = sorted((set(vocabulary()) - COMMON) | {p.split()[-1] for p in PHRASES})
    none = F.array().cast("array<string>")
    # Full lower case finds at least the ways in, and parts words where they were parted.
    df = df.withColumn("low", F.when(F.col("t") == "", none).otherwise(F.split(F.lower("t"), GAP)))
    way = F.arrays_overlap("low", F.array(*[F.lit(w) for w in ways]))
    return df.select("doc_id", F.size("low").cast("long").alias("n_words"), F.when(way, F.split(F.translate("t", UPPER, LOWER), GAP)).alias("ws"))


def _frequencies(scanned: DataFrame) -> dict[str, int]:
    """In how many files each licence word is; a row for each word of the vocabulary at most."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    words = scanned.where(F.col("ws").isNotNull()).select(F.explode(F.array_intersect("ws", known)).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _starts(phrase: str) -> Column:
    """Where a phrase's words stand consecutively."""
    words = phrase.split()

    def here(w: Column, i: Column) -> Column:
        ok = w == words[0]
        for k, x in enumerate(words[1:], 1):
            ok = ok & F.coalesce(F.get("ws", i + k) == x, F.lit(False))
        return F.when(ok, i)

    return F.array_compact(F.transform("ws", here))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the best alignments."""
    scanned = written(scan(docs), "licenses")
    df = _frequencies(scanned)
    # Postings of each key phrase's rarest word: template and place.
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, ws in enumerate(_templates()):
        for start, n in _key_spans(t):
            p = min((p for p in range(start, start + n) if ws[p] not in COMMON), key=lambda p: (df.get(ws[p], 0), ws[p]))
            postings.setdefault(ws[p], []).append((t, p))
    table = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[w]]))])
    found = scanned.where(F.col("ws").isNotNull())
    rest = scanned.where(F.col("ws").isNull())

    for n, p in enumerate(PHRASES):
        found = found.withColumn(f"base{n}", _starts(p))
    # Each place of a rare word and each of its postings say where a template would begin.
    places = F.array_compact(F.transform("ws", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("at")))))
    places = F.when(F.arrays_overlap("ws", F.array(*[F.lit(w) for w in sorted(postings)])), places).otherwise(F.array().cast("array<struct<w:string,at:int>>"))
    begins = F.flatten(F.transform(places, lambda e: F.transform(table[e["w"]], lambda q: F.struct(q["t"].alias("t"), (e["at"] - q["p"]).alias("offset")))))
    found = found.withColumn("begins", begins)
    templates = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in _templates()])
    spans = F.array(*[F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in _key_spans(t)]) for t in range(len(TEMPLATES))])

    def aligned(e: Column) -> Column:
        """The share of a template's words that the file has near their places, and if a key phrase is at its own."""
        words = F.get(templates, e["t"])

        def near(w: Column, p: Column) -> Column:
            low, high = F.greatest(e["offset"] + p - DRIFT, F.lit(0)), e["offset"] + p + DRIFT
            return F.array_contains(F.slice(F.col("ws"), low + 1, F.greatest(high - low + 1, F.lit(0))), w)

        def there(k: Column) -> Column:
            return F.forall(F.sequence(k["a"], k["a"] + k["n"] - 1), lambda p: F.coalesce((e["offset"] + p >= 0) & (F.get("ws", e["offset"] + p) == F.get(words, p)), F.lit(False)))

        key = F.exists(F.get(spans, e["t"]), there)
        share = F.size(F.filter(F.transform(words, near), lambda x: x)) / F.size(words).cast("double")
        return F.struct(e["t"].alias("t"), F.when(key, share).otherwise(F.lit(0.0)).alias("score"), key.alias("key"))

    found = found.withColumn("aligned", F.transform("begins", aligned))
    labels = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    base = F.concat(*[F.col(f"base{n}") for n in range(len(PHRASES))])
    found = found.withColumn("base", base)
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base{n}") > 0, F.lit(x)) for n, x in enumerate(PHRASES.values())]))
    good = F.filter("aligned", lambda a: a["key"] & (a["score"] >= MIN_SCORE))
    found = found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(good, lambda a: F.get(labels, a["t"]))))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.filter("aligned", lambda a: a["key"]), lambda a: a["score"])), F.lit(0.0)).alias("score"),
    )
    none = F.lit(None).cast("long")
    rest = rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return found.unionByName(rest)

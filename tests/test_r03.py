"""What the third round of findings was about."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell import catalog
from siftwell.functions import analysis, scalar
from siftwell.functions.analysis import SIMPLE
from siftwell.functions.arrays import groups
from siftwell.operators import index as stored, match, triples
from siftwell.operators.index import Index
from siftwell.plans.parts import DateRange, Prefix


def _lean(rows):
    """The rows that stay, by the words of the contract."""
    said = {}
    for s, p, o in rows:
        said.setdefault(s, set()).add((p, o))
    pointed = {o for _, _, o in rows}

    def goes(s):
        return s.startswith("_:") and s not in pointed and any(t != s and said[s] <= said[t] and (said[s] < said[t] or not t.startswith("_:") or t < s) for t in said)

    return sorted(r for r in rows if not goes(r[0]))


def test_lean_of_any_triples(spark):
    rng = random.Random(7)
    for _ in range(3):
        things = [f"_:{k}" for k in range(40)] + ["a:1", "a:2", "a:3"]
        rows = sorted({(rng.choice(things), rng.choice("pq"), rng.choice(["1", "2", "3", "", "_:1", "_:2"])) for _ in range(rng.choice([60, 90, 130]))})
        got = triples.lean(spark.createDataFrame(rows, "s string, p string, o string"))
        assert sorted(map(tuple, got.collect())) == _lean(rows)


def test_lean_of_many_that_say_the_same(spark):
    df = spark.range(20_000).select(F.concat(F.lit("_:"), "id").alias("s"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("p"), F.lit("x").alias("o"))
    began = time.monotonic()
    assert sorted(map(tuple, triples.lean(df).collect())) == [("_:0", "p", "x"), ("_:0", "q", "x")]
    assert time.monotonic() - began < 60


def test_open_date_ranges_have_no_bounds(spark):
    times = ["1950-06-01 00:00:00", "2024-01-01 00:00:00", "2039-01-01 00:00:00", "9000-01-01 00:00:00", None]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(times)] + [("late", None), ("odd", None)], "uri string, t string")
    dated = F.when(F.col("uri") == "late", "123450101000000").when(F.col("uri") == "odd", "soon").otherwise(scalar.date_string(F.to_timestamp("t")))
    docs = df.select("uri", F.to_timestamp("t").alias("ts"), F.lit("").alias("text"), match.properties(match.prop("d", "at", dated)).alias("properties"))

    def found(start, end, key):
        return "".join(sorted(r["uri"][0] for r in match.Matcher(SIMPLE).search(match.analyzed(docs, SIMPLE), DateRange(start, end, key)).collect()))

    day = datetime(2024, 1, 1)
    assert [found(*x, "Timestamp") for x in ((day, None), (None, day), (None, None), (datetime(2100, 1, 1), None), (datetime(2050, 1, 1), day))] == ["123", "01", "0123", "3", "12"]
    assert [found(*x, "at") for x in ((day, None), (None, day), (None, None), (day, datetime(2050, 1, 1)))] == ["123l", "01", "0123l", "12"]


def test_years_of_five_digits(spark):
    df = spark.createDataFrame([(0,), (253402300799,), (253402300800,), (3110363913601,)], "n long").select(scalar.from_unix_time(F.col("n")).alias("ts"))
    got = df.select(scalar.date_string(F.col("ts")), scalar.date_at(F.col("ts"), "month"), scalar.year_month(F.col("ts")), scalar.pretty_date(F.col("ts"), F.lit("2024-01-01").cast("timestamp"))).collect()
    assert [tuple(r) for r in got[1:3]] == [("99991231235959", "999912", "999912", "9999-12-31"), ("100000101000000", "1000001", "1000001", "10000-01-01")]
    assert got[0][0] == "19700101000000" and got[3][0].isdigit()


def test_groups_of_sorted_arrays(spark):
    df = spark.createDataFrame([(["b", "a", "b", None, "c", "a"],), ([],), (["x"],)], "t array<string>")
    xs = F.sort_array(F.transform("t", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    got = [[(x["term"], x["pos"]) for x in r["g"]] for r in df.select(groups(xs, "term", ["pos"]).alias("g")).collect()]
    assert got == [[(None, [3]), ("a", [1, 5]), ("b", [0, 2]), ("c", [4])], [], [("x", [0])]]


def test_index_has_as_many_files_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "TASK_POSTINGS", 500)
    docs = spark.range(300).select(F.concat(F.lit("u:"), F.col("id") % 299).alias("uri"), F.lit(None).cast("string").alias("parent_uri"), F.concat(F.lit("a b a c"), F.col("id") % 7, F.lit(" a")).alias("text"), F.array().cast(f"array<{match.PROPERTY}>").alias("properties"))
    index = Index(spark, str(tmp_path / "i"), SIMPLE)
    index.add(docs, 1)
    # Once 900 rows of a term and a document were as many rows as occurrences, in one file.
    files = [f for f in (tmp_path / "i" / index.segments()[0]["name"] / "postings").iterdir() if f.suffix == ".parquet"]
    assert len(files) == 2 and index.lists().count() == 900 and index.postings().count() == 1500
    assert sorted(map(tuple, index.vocab().collect())) == [("Text", "a", 299, 900), ("Text", "b", 299, 300), ("Text", "c", 299, 300)]
    assert sorted(r["pos"] for r in index.postings((F.col("term") == "a") & (F.col("uri") == "u:5")).collect()) == [0, 2, 4]
    some = index.search(Prefix("a")).count()
    monkeypatch.setattr(stored, "NAMED_TERMS", 0)
    assert some == index.search(Prefix("a")).count() == 299
    assert {(r["tf"], tuple(r["positions"])) for r in index.vectors().where("uri <> 'u:0'").collect()} == {(3, (0, 2, 4)), (1, (1,)), (1, (3,))}
    assert {r["tf"] for r in index.vectors().where("uri = 'u:0'").collect()} == {6, 2}
    # Terms of a text are gathered in its row; only documents that share a URI are shuffled.
    assert {tuple(map(tuple, r["offsets"])) for r in index.vectors().where("uri = 'u:5' and term = 'a'").collect()} == {((0, 1), (4, 5), (9, 10))}
    alone = Index(spark, str(tmp_path / "a"), SIMPLE)
    alone.add(docs.where("uri <> 'u:0'"), 1)
    assert "Aggregate" not in alone.vectors()._jdf.queryExecution().optimizedPlan().toString() and alone.vectors().count() == 3 * 298


#: Queries that use the terms of a text more than once.
OFTEN = ["multi_phrase", "text_phrase", "sloppy_phrase", "span_not", "span_near", "analyzer_standard"]


@pytest.mark.parametrize("name", OFTEN)
def test_terms_are_worked_out_once(spark, name):
    """A filter that takes the place of terms by their pattern had it once for each word, or for each term of a text."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    asks = 2 if name in ("text_phrase", "sloppy_phrase") else 1  # the text, and the text properties
    assert plan.count("regexp_extract_all") == asks


def test_offsets_are_read_without_copies_of_the_text(spark):
    plan = catalog.QUERIES["index_offsets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    texts = ["", "Ünder the é 12 Bridge", "x" * 127 + " " + "y" * 300 + " z\n" + "𝒜b " * 200, "a\r\nb\u2028c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), analysis.tokens(F.col("t")).alias("x"))
    for r in df.select("t", "x", analysis.at_places(F.col("t"), F.col("x")).alias("read")).collect():
        assert r["read"] == [r["t"][x["start"] : x["end"]] for x in r["x"]] and [w.lower() for w in r["read"]] == [x["term"] for x in r["x"]]


def test_the_standard_grammar_as_it_was(spark):
    was = r"""[\p{L}\p{N}]+(?:[._+-][\p{L}\p{N}]+)*@[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)+|\p{L}\.(?:\p{L}\.)+|\p{L}+[&@]\p{L}+|[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)+|[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*(?:[_,/-][\p{L}\p{N}]+)+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|\p{L}+(?:'\p{L}+)+|[\p{L}\p{N}]+"""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaBbé漢あ12²..@@&'_,-+/ ") for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in (f"({was})", analysis.STANDARD)]
    assert df.where(found[0] != found[1]).limit(3).collect() == []
    assert [r["x"] for r in df.select(analysis.standard_terms(F.col("t")).alias("x")).collect()] == [analysis.STANDARD_ANALYZER.terms(t) for t in texts]

from pyspark.sql import functions as F

from siftwell.functions import scalar
from siftwell.operators import changes, match, spans
from siftwell.operators.snippets import snippet
from siftwell.streaming import live


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_scalars(spark):
    assert one(spark, "someFileName2Go.txt", scalar.fuzzy_divide) == "some File Name 2 Go txt"
    assert one(spark, "a <b>c</b> < d", scalar.strip_tags) == "a c < d"
    assert one(spark, "Joe_X@mail.Example.com", scalar.sanitize_email) == "joe x mail example"
    assert one(spark, "//a/b/", scalar.sanitize_path) == "/a/b"
    assert one(spark, 'a "b c" d', scalar.split_quoted) == ["a", "b c", "d"]
    assert one(spark, "ab cdef g", lambda c: scalar.count_words(c, -1, 3)) == 2
    assert one(spark, "abc", lambda c: scalar.glob_match("a*", c)) is True
    assert one(spark, "", lambda c: scalar.glob_match("a", c)) is False


def test_sloppy_distance(spark):
    df = spark.createDataFrame([(["a", "x", "x", "b"],), (["b", "a"],), (["a"],)], "t array<string>")
    got = [r["d"] for r in df.select(match.sloppy_distance(F.col("t"), ["a", "b"]).alias("d")).collect()]
    assert got == [2, 2, None]


def test_spans_near(spark):
    df = spark.createDataFrame([(["a", "x", "b", "a"],)], "t array<string>")
    near = df.select(spans.near(spans.term(F.col("t"), "a"), spans.term(F.col("t"), "b"), 1, ordered=False).alias("s")).first()["s"]
    assert [(s["first"], s["end"]) for s in near] == [(0, 3), (2, 4)]


def test_coalesced(spark):
    kv = "array<struct<key:string,value:string>>"
    rows = [(1, "add", "u", None, []), (2, "property", "u", None, [("a", "1")]), (3, "property", "u", None, [("a", "2")]), (4, "add", "v", None, []), (5, "remove", "v", None, []), (6, "property", "v", None, [("b", "1")]), (7, "property", "w", None, [("c", "1")])]
    df = spark.createDataFrame(rows, f"seq long, op string, uri string, parent_uri string, properties {kv}")
    got = {r["uri"]: (r["op"], [tuple(p) for p in r["properties"]]) for r in changes.coalesced(df).collect()}
    assert got == {"u": ("add", [("a", "2")]), "v": ("remove", []), "w": ("property", [("c", "1")])}


def test_sessions(spark):
    rows = [("x", f"2024-01-01 10:{i // 60:02d}:{i % 60:02d}", i) for i in range(60)] + [("x", "2024-01-01 15:59:00", 60), ("x", "2024-01-01 16:00:01", 61), ("x", "2024-01-01 23:00:00", 62), ("x", "2024-01-02 00:10:00", 63)]
    df = spark.createDataFrame(rows, "g string, t string, line long").select("g", F.to_timestamp("t").alias("ts"), "line")
    got = {r["line"]: r["session"] for r in changes.sessions(df, "g").collect()}
    assert [got[k] for k in (0, 59, 60, 61, 62, 63)] == ["2024-01-01/1"] * 3 + ["2024-01-01/2"] * 2 + ["2024-01-02/1"]


def test_snippet_context():
    text = "one two three four five six seven hit a b c d e f g"
    (found,) = snippet(text, ["hit"])
    assert [f["text"] for f in found["fragments"]] == ["three four five six seven ", "hit", " a b c d e f"]
    assert snippet("nothing here", ["hit"]) == []


def test_live_stream(spark, tmp_path):
    schema = "uri string, text string"
    spark.createDataFrame([("a", "hit"), ("b", "miss"), ("c", "hit")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("a",)], "uri string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = live.listen(stream, lambda d: d.where(F.col("text") == "hit"), lambda d, n: d.write.mode("overwrite").parquet(f"{out}/{n}"), lambda: first, str(tmp_path / "check"))
    query.awaitTermination(60)
    got = spark.read.parquet(f"{out}/0")
    assert sorted((r["op"], r["uri"]) for r in got.collect()) == [("+", "a"), ("+", "c"), ("-", "a")]
    assert sorted(r["uri"] for r in live.applied(first, got).collect()) == ["a", "c"]

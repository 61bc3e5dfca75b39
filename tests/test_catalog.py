"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from siftwell import catalog
from siftwell.functions.analysis import SIMPLE
from siftwell.operators import snippets

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(str, frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() >= 0


def test_snippets_of_all_hits(spark, duck):
    want = {}
    for i, text in duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        if "thing" in SIMPLE.terms(text):
            lines = [f"{{{x['line']}, [" + ", ".join(f"{{{f['term']}, {f['text']}}}" for f in x["fragments"]) + "]}" for x in snippets.snippet(text, ["thing"])]
            want[f"doc:{i}"] = "[" + ", ".join(lines) + "]"
    got = catalog.QUERIES["snippet"](spark, SF_DIR).collect()
    assert len(got) == len(want) > 20 and {r["uri"]: r["snippet"] for r in got} == want

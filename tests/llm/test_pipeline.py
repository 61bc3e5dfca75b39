"""The pipeline's stages follow one another, keep clean documents and let their decisions take effect."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import queries
from siftwell.llm.shared import written

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and 0.5 * counts[0] < counts[-1] < counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    total = sum(len(r["text"].encode()) for r in docs.collect())
    assert sum(r["length"] for r in packed.collect()) == total
    again = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, again.collect())) == sorted(map(str, packed.collect()))


def test_hostile_rows_go_through_all_stages(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns of clashing names, and an empty table."""
    rng = random.Random(1)
    prose = [" ".join(f"word{rng.randrange(4000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, " \n\t", None, "src0", 3), (3, prose[0], "en", None, None), (3, prose[0], "en", None, None), (None, prose[1], None, None, 1), (4, prose[0], "de", "src1", 9)]
    rows += [(5, " ".join(f"w{k}" for k in range(30_000)), "en", "src0", 1), (6, prose[2] + " joe@x.example.com", "en", "src0", 7), (7, prose[3], "en", "src0", 2), (7, prose[4], "en", "src0", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"kept": F.lit("x"), "class": F.lit(1), "row": F.lit(None).cast("string"), "t": F.lit(2.5)})
    columns, texts = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        texts = written(stage(spark, texts, SF_DIR), name)
        assert texts.columns == columns, name
    kept = texts.collect()
    assert sorted((r["doc_id"] or 0, len(r["text"].split())) for r in kept) == [(0, 80), (3, 80), (3, 80), (6, 81), (7, 80), (7, 80)]  # 5 is an outlier by its length
    assert [r["text"].endswith("[EMAIL]") for r in kept if r["doc_id"] == 6] == [True]
    packed = corpus_pipeline.STAGES[-1][1](spark, texts, SF_DIR).collect()
    assert sum(r["length"] for r in packed) == sum(len(r["text"].encode()) for r in kept)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))

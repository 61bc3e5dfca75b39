from pyspark.sql import functions as F

from siftwell.engine import Engine
from siftwell.sources.registry import SOURCES, Source, changed_files, excluded, of_files, rebased


def test_files_become_documents(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "notes" / "MyPlan2Do.txt").write_text("the alpha plan")
    (tmp_path / "notes" / "skip.bak").write_text("alpha")
    (tmp_path / ".hidden" / "x.txt").write_text("alpha")
    docs = of_files(spark, str(tmp_path), SOURCES["Files"], ["*.bak"]).cache()
    engine = Engine(docs)
    assert [r["uri"].rpartition("/")[2] for r in engine.matches("alpha").collect()] == ["MyPlan2Do.txt"]
    assert engine.count('"my plan do"') == 1 and engine.count("ext:txt") == 1
    assert docs.where(F.col("ts").isNull()).count() == 0


def test_exclusion(spark):
    df = spark.createDataFrame([("/a/b.txt",), ("/a/.git/x",), ("/tmp/b.o",), ("/a/build7/c",)], "p string")
    assert [r["x"] for r in df.select(excluded(F.col("p"), ["*.o", "/build[0-9]/"]).alias("x")).collect()] == [False, True, True, True]


def test_change_detection(spark):
    schema = "path string, mtime long, filter_version int"
    new, gone = changed_files(spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], schema), spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("d", 1, 1)], schema))
    assert sorted(r["path"] for r in new.collect()) == ["b", "c"] and [r["path"] for r in gone.collect()] == ["d"]


def test_all_sources_and_mounts(spark):
    assert len(SOURCES) == 25 and all(isinstance(s, Source) for s in SOURCES.values())
    row = rebased(spark.createDataFrame([("/x", None)], "uri string, parent_uri string"), "/media/disk/").first()
    assert tuple(row) == ("/media/disk/x", None)

from pyspark.sql import functions as F

from siftwell.engine import Engine, main
from siftwell.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def test_engine(spark, tmp_path, capsys):
    docs = tables.documents(spark, SF_DIR).where("uri < 'doc:15'").unionByName(tables.parts(spark, SF_DIR).where("uri < 'part:11'"))
    engine = Engine(docs)
    hits = engine.search("thing", 5)
    assert {"uri", "score", "properties"} <= set(hits.columns) and "terms" not in hits.columns
    assert hits.groupBy("source").count().where("count > 5").count() == 0
    assert hits.where("score <= 0").count() == 0
    assert engine.count("thing") == docs.where(F.lower("text").rlike(r"(?<!\p{L})thing(?!\p{L})")).count()
    assert engine.count("thing", scope="files") == engine.count("thing") and engine.count("thing", scope="mail") == 0
    assert engine.snippets(engine.matches("thing"), "thing").where(F.size("snippet") == 0).count() == 0
    gone = engine.removed(hits.select("uri"))
    assert gone.count("thing") == engine.count("thing") - hits.count()
    assert gone.merged(engine).docs.count() == docs.count()
    assert engine.added(hits.select(*docs.columns)).docs.count() == docs.count()
    engine.build(str(tmp_path / "index"), 2)
    main([str(tmp_path / "index"), "count", "thing"])
    assert capsys.readouterr().out.strip().split("\n")[-1] == str(engine.count("thing"))

"""Tables as documents: each adapter gives uri, parent_uri, ts, source, domain, hit_type, mime_type, text and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.scalar import date_string
from siftwell.operators.match import prop, properties
from siftwell.plans.parts import LOCAL, SYSTEM

#: Documents without a time of their own get one an hour after the other from here.
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _document(df: DataFrame, uri: Column, props: Column, *, parent: Column | None = None, ts: Column | None = None, source: Column | None = None, hit_type: str = "File", mime: str = "text/plain", text: Column | None = None, domain: int = LOCAL) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        uri.alias("uri"),
        (none if parent is None else parent).alias("parent_uri"),
        (F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"),
        (none if source is None else source).alias("source"),
        F.lit(domain).alias("domain"),
        F.lit(hit_type).alias("hit_type"),
        F.lit(mime).alias("mime_type"),
        (none if text is None else text).alias("text"),
        props.alias("properties"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents")
    ts = F.timestamp_add("HOUR", F.col("doc_id"), F.lit(EPOCH).cast("timestamp"))
    props = properties(prop("k", "dc:language", F.col("lang")), prop("k", "dc:source", F.col("source")), prop("k", "fixme:filesize", F.col("n_chars"), searched=False))
    return _document(df, F.concat(F.lit("doc:"), F.col("doc_id")), props, ts=ts, source=F.col("source"), text=F.col("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    parent = F.concat(F.lit("im:"), F.col("conv_id"))
    return _document(df, F.concat(parent, F.lit("#"), F.col("turn")), properties(prop("k", "fixme:speaker", F.col("role"))), parent=parent, source=F.lit("IMLog"), hit_type="IMLog", text=F.col("text"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    props = properties(
        prop("k", "order:status", F.col("o_orderstatus")),
        prop("t", "order:priority", F.col("o_orderpriority")),
        prop("k", "order:customer", F.col("o_custkey"), searched=False),
        prop("d", "order:date", date_string(F.col("o_orderdate").cast("timestamp"))),
    )
    return _document(df, F.concat(F.lit("order:"), F.col("o_orderkey")), props, ts=F.col("o_orderdate").cast("timestamp"), source=F.lit("orders"), hit_type="Order", domain=SYSTEM)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    props = properties(prop("t", "dc:title", F.col("p_name")), prop("k", "part:brand", F.col("p_brand")), prop("k", "part:type", F.col("p_type")), prop("k", "part:size", F.col("p_size"), searched=False))
    return _document(df, F.concat(F.lit("part:"), F.col("p_partkey")), props, source=F.lit("part"), hit_type="Part", domain=SYSTEM)

"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import best_fit, flac, license_index, mcd_rules, minmax_dedup, prefix_bpe, quote_linking, toxicity_chain, url_filter, weak_pii
from siftwell.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.conversations(_table(spark, sf_dir, "conversations"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the canonical URLs of the pages whose id is divisible by 50; all pages are judged."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_pages(pages))


def op3_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_rules.judge(_table(spark, sf_dir, "documents"))


#: The categories of the chain, in order; the last one is the verdict.
CATEGORIES = ["low_quality", "toxic"]


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.judge(_table(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir), CATEGORIES, "toxic")


def tokenizer_path() -> str:
    """Where the installed public tokenizers keep the vocabulary; each executor reads its own copy."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.detect(_table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(_table(spark, sf_dir, "documents"))


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.judge(_table(spark, sf_dir, "documents"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are stored as a table, and what that holds is read back block by block. The table's codec
    takes out what sound coding leaves: headers, seek tables, and above all what repeats in coded frames."""
    return flac.read_back(written(flac.store(_table(spark, sf_dir, "documents")), "media", compression="zstd"))


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quote_linking": op1_quote_linking,
    "op2_url_filter": op2_url_filter,
    "op3_mcd_rules": op3_mcd_rules,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_weak_pii": op6_weak_pii,
    "op7_best_fit": op7_best_fit,
    "op8_license_index": op8_license_index,
    "op9_flac": op9_flac,
    "op10_minmax_dedup": op10_minmax_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quote_linking": quote_linking.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op10_minmax_dedup": minmax_dedup.ORACLE,
}

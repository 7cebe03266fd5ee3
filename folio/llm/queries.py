"""Registered queries of the training-data operators, and their DuckDB SQL
where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import conversation_repair, jaccard_join, license_scan, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, source_divergence, suffix_dedup, token_files, vector_topk, warc
from folio.llm.storage import ship_package
from folio.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings, and this package in the Python workers."""
    configure(spark)
    # whole texts travel in Arrow batches: fewer rows each bound a worker's memory
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)
    return spark


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        return fn

    return deco


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"))


@register("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digest(table(spark, sf_dir, "documents"))


@register("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


@register("op5_exact_topk")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"))


@register("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@register("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


@register("op8_ngram_jaccard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


@register("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op11_source_divergence")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


@register("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


@register("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


ORACLES: dict[str, str] = {
    "op4_warc": warc.oracle_sql(),
    "op5_exact_topk": vector_topk.oracle_sql(),
    "op6_quality_rules": quality_rules.oracle_sql(),
    "op11_source_divergence": source_divergence.oracle_sql(),
}

"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's docs.

1. quality classifier: documents scored below the threshold go;
2. n-gram Jaccard join: of each group of near duplicates the smallest id stays;
3. suffix-array dedup: byte strings of 200 that repeat are cut out; a document
   of which nothing is left goes;
4. secret scans: secrets are replaced by a mark;
5. packing: the documents' ids in sequences of 1024.

Null texts count as empty and stay unless a rule removes them; extra columns
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import jaccard_join, packing, quality_classifier, secret_scan, suffix_dedup
from folio.llm.queries import prepared, table
from folio.llm.storage import stored

THRESHOLD = 0.7


def _with_text(docs: DataFrame, text) -> DataFrame:
    """Replace the text, and the character count where there is one."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 1."""
    prepared(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality_classifier.train(docs, labels, usable=~quality_classifier.held_out())
    return quality_classifier.score(docs, weights, output="__score").filter(F.col("__score") >= THRESHOLD).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepared(spark)
    return jaccard_join.one_per_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that also occur elsewhere."""
    prepared(spark)
    done = suffix_dedup.remove_repeats(docs, as_text=True).filter((F.size("__spans") == 0) | (F.length(F.trim("__kept")) > 0))
    return _with_text(done, F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.col("__kept"))).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    prepared(spark)
    return _with_text(secret_scan.redact(docs), F.col("text")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("secret_scans", secrets),
    ("packing", pack),
]

#: SQL cannot express the classifier, the automaton or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

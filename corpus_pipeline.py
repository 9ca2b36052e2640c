"""From raw documents to packed training sequences: quality filter, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from counterpoise.llm import decontaminate, minhash, packing, pii, quality
from counterpoise.llm.common import cut, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on them, keeps."""
    return quality.classify(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    gone = cut(minhash.near_duplicates(docs).filter("doc_id is not null and not kept").select("doc_id").distinct(), "dropped")
    return docs.join(minhash.few(gone), "doc_id", "left_anti").select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal datum replaced by its kind in brackets; n_chars follows the text."""
    clean = pii.redact(pii.detect(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(cut(packing.tokenise(docs, packing.tokenizer_path()), "pieces"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_dedup),
    ("decontamination", benchmark_filter),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: Expectation maximisation, signatures and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

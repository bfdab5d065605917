"""From raw documents to token ids, in five stages.

Each stage takes what the one before it kept, written as Parquet and read
again.  The first four return the columns of the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm import bpe, language, simhash, substring, tiling
from leakscan.llm.store import stored

ORACLE_SQL = None  # language models and token ids are beyond SQL; tests compare with a brute-force version


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents with no language (no letter at all, or no text) go.

    An ambiguous language is no ground to reject: short clean texts have one.
    """
    found = language.identify(docs, language.train(docs))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest id stays."""
    kept = simhash.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi"))


def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages stay in the first document only; emptied documents go.

    Where a text gets shorter, so does n_chars.
    """
    cut = substring.dedup(docs, removed_col="n_removed")
    left = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(size))
    return left.select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item of the benchmark go.

    A row with a null id is kept only if no such row holds an item.
    """
    found = tiling.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found.withColumnRenamed("doc_id", "found"), F.col("doc_id").eqNullSafe(F.col("found")), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token ids of each document, and digests of ids and decoded bytes."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, tokenizer, keep_ids=True)


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", distinct),
    ("substring dedup", trimmed),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""Reading corpora stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.text import is_blank, nbsp_to_space


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def composer_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts as typed: non-breaking spaces read as spaces, blank ones skipped."""
    cleaned = df.withColumn(text_col, nbsp_to_space(F.col(text_col)))
    return cleaned.filter(~is_blank(F.col(text_col)))

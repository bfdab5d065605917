"""Importing and exporting packs of user patterns as JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions import typed
from leakscan.functions.arrays import bind
from leakscan.functions.text import sanitize_flags, ws_trim
from leakscan.operators.policy import moment
from leakscan.operators.rules import STARTER_PACK

PATTERN = "label: string, pattern: string, flags: string, category: string, explanation: string, placeholder: string"
PACK_SCHEMA = f"name string, description string, patterns array<struct<{PATTERN}>>"
# Fixed values.
DEFAULT_PACK_NAME = "Imported pack"
DEFAULT_PACK_DESCRIPTION = "Imported rule pack."
EXPORT_NAME = "Rule export"
EXPORT_DESCRIPTION = "Exported custom rules."


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Rule packs from JSON files, one object per file."""
    return parse_packs(spark.read.text(path, wholetext=True), "value")


def parse_packs(df: DataFrame, json_col: str) -> DataFrame:
    """Rule packs held as JSON text in a column; what is not an object is skipped.

    Fields of the wrong type read as missing.
    """
    others = [c for c in df.columns if c != json_col]
    # A table of packs is small for the work it makes: it may come as one split.
    texts = typed.spread(df).withColumnRenamed(json_col, "__json")
    packs = bind(texts, typed.parsed(F.col("__json")), "pack").filter(typed.is_object(F.col("pack")))
    pack = F.col("pack")
    patterns = F.transform(typed.items(pack, "patterns"), _pattern)
    read = packs.select(*others, typed.text(pack, "name").alias("name"), typed.text(pack, "description").alias("description"), "pack")
    return bind(read, patterns, "patterns").drop("pack")


def _pattern(entry: Column) -> Column:
    names = ("label", "pattern", "flags", "category", "explanation", "placeholder")
    return F.struct(*(typed.text(entry, name).alias(name) for name in names))


def starter_pack(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([STARTER_PACK], PACK_SCHEMA)


def imported_patterns(packs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The usable patterns of each pack, as custom patterns.

    Their category is not checked yet: that is left to ``normalize_custom``.
    """
    rows = packs.select(*by, "name", F.posexplode("patterns").alias("pos", "p")).filter(_usable(F.col("p")))
    return rows.select(
        *by,
        F.sha2(
            F.concat_ws("\n", *(F.col(c).cast("string") for c in (*by, "name", "pos")), "p.label", "p.pattern"), 256
        ).alias("id"),
        ws_trim(F.col("p.label")).alias("label"),
        F.col("p.pattern").alias("pattern"),
        sanitize_flags(F.coalesce("p.flags", F.lit("g"))).alias("flags"),
        F.col("p.category").alias("category"),
        F.lit(True).alias("enabled"),
        _text_or_null(F.col("p.explanation")).alias("explanation"),
        _text_or_null(F.col("p.placeholder")).alias("placeholder"),
    )


def imported_meta(packs: DataFrame, as_of: datetime | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One record per imported pack, counting its usable patterns."""
    patterns = F.coalesce("patterns", F.array().cast(packs.schema["patterns"].dataType))
    return packs.select(
        *by,
        F.coalesce("name", F.lit(DEFAULT_PACK_NAME)).alias("name"),
        F.coalesce("description", F.lit(DEFAULT_PACK_DESCRIPTION)).alias("description"),
        moment(as_of).alias("imported_at"),
        F.size(F.filter(patterns, _usable)).alias("pattern_count"),
    )


def _usable(p: Column) -> Column:
    return p.label.isNotNull() & p.pattern.isNotNull() & p.category.isNotNull()


def _text_or_null(value: Column) -> Column:
    return F.nullif(ws_trim(value), F.lit(""))


def export_patterns(custom: DataFrame) -> DataFrame:
    """One JSON document per pattern, switched-off ones included.

    Written as JSON lines this scales to any number of patterns; see
    ``export_packs`` for whole packs.
    """
    return custom.select(F.to_json(_exported()).alias("pattern_json"))


def export_packs(custom: DataFrame, by: tuple[str, ...] = (), order: str = "id") -> DataFrame:
    """A whole pack as one JSON text, per user when ``by`` is given.

    A pack is one document: all patterns of a user meet in one row.  Patterns
    of any number are written as lines by ``export_patterns``.
    """
    pack = F.struct(
        F.lit(EXPORT_NAME).alias("name"),
        F.lit(EXPORT_DESCRIPTION).alias("description"),
        F.transform("rows", lambda x: x.p).alias("patterns"),
    )
    return (
        custom.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), _exported().alias("p")))).alias("rows"))
        .select(*by, F.to_json(pack).alias("pack_json"))
    )


def _exported() -> Column:
    return F.struct("label", "pattern", "flags", "category", "explanation", "placeholder")

"""Files as a source of texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.operators.attachments import TEXT_EXTENSIONS
from leakscan.operators.chunks import CHUNK


def read_files(spark: SparkSession, path: str, *, input_id: str, batch_ts: datetime) -> DataFrame:
    """Text-like files under a path, as one selection, in the shape the attachment scan takes.

    ``input_id`` and ``batch_ts`` say where and when the files were selected;
    ``path`` is added.  A file is one text and is read whole.  The extension gate is a filter on the path, which the reader applies before
    it opens a file.
    """
    gate = F.lit(False)
    for extension in TEXT_EXTENSIONS:
        gate = gate | F.lower("path").endswith(extension)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(gate)
    return found.select(
        F.lit(input_id).alias("input_id"),
        F.lit(batch_ts).cast("timestamp").alias("batch_ts"),
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.lit(None).cast("string").alias("file_type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        # Bytes that are not UTF-8 become replacement characters; a leading mark is dropped.
        F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\A\ufeff", "").alias("text"),
    )


def read_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Text-like files of any size as rows (path, block, chunk, text) of whole lines, for ``chunks.scan_chunks``.

    A file is read by as many tasks as it has splits; ``block`` is where a split
    begins.  Bytes that are not UTF-8 become replacement characters; a leading
    mark is dropped.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    gate = F.lit(False)
    for extension in TEXT_EXTENSIONS:
        gate = gate | F.lower("path").endswith(extension)
    placed = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.make_valid_utf8("value").alias("line"),
    ).filter(gate)
    of_block = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A chunk begins at the first line that starts beyond another multiple of the size.
    before = F.coalesce(F.sum(F.length("line") + 1).over(of_block), F.lit(0))
    numbered = placed.withColumn("chunk", F.floor(before / size).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    chunks = numbered.groupBy("path", "block", "chunk").agg(text.alias("text"))
    first = (F.col("block") == 0) & (F.col("chunk") == 0)
    return chunks.withColumn("text", F.when(first, F.regexp_replace("text", r"\A\ufeff", "")).otherwise(F.col("text")))

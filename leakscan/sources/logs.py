"""The incident log on disk: an append-only table partitioned by day, with sums that are kept up as it grows."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.functions import typed
from leakscan.operators.incidents import (
    LOG_SCHEMA, MAX_LOG_ENTRIES, day_sums, label_sums, retain, valid_entries,
)
from leakscan.sources.shared import stored


ENTRY_FILES, LABEL_FILES, DAY_FILES, COMMITS = "entries", "labels", "days", "commits"
LABELS_SCHEMA = "label string, entries bigint, age bigint, id string, pos int, batch string, day date"
DAYS_SCHEMA = "incidents bigint, secrets bigint, pii bigint, batch string, day date"


def _missing(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _commit(path: str, batch: str) -> str:
    return f"{path}/{COMMITS}/{hashlib.sha256(batch.encode()).hexdigest()}"


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the batch is complete."""
    return not _missing(spark, f"{_commit(path, batch)}/_SUCCESS")


def append_log(entries: DataFrame, path: str, batch: str | None = None) -> None:
    """Add entries, each id once, and count them in the rollups.

    A log is a folder: entries by day, sums by day and by day and label, and the
    names of the batches that are complete.  A batch that is complete is not
    added again.  One that was cut short may be: what it has stored already is
    found by id in the days it touches, and its sums are written anew.  Entries
    are rebalanced by day: few files, and a busy day is split.
    """
    spark = entries.sparkSession
    batch = batch or uuid.uuid4().hex
    if has_batch(spark, path, batch):
        return
    dated = entries.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch))
    dated = stored(dated.dropDuplicates(["day", "id"]), "log-batch")
    own = dated
    if not _missing(spark, f"{path}/{ENTRY_FILES}"):
        # A row for each day that the batch touches.
        days = [r.day for r in dated.select("day").distinct().collect()]
        held = _entries(spark, path).filter(F.col("day").isin(days)).select("day", "id", F.col("batch").alias("owner"))
        met = dated.join(held, ["day", "id"], "left")
        own = stored(met.filter("owner is null or owner = batch"), "log-own")
        dated = own.filter("owner is null").drop("owner")
        own = own.drop("owner")
    dated.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(f"{path}/{ENTRY_FILES}")
    for name, sums in ((LABEL_FILES, label_sums(own)), (DAY_FILES, day_sums(own))):
        # A folder for each batch: a batch that runs again replaces its own.
        part = f"{path}/{name}/{hashlib.sha256(batch.encode()).hexdigest()}"
        # Few files, but not by one task: it would have to read all that the sums are made from.
        sums.withColumn("batch", F.lit(batch)).hint("rebalance", F.col("day")).write.mode("overwrite").parquet(part)
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(_commit(path, batch))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA + ", batch string, day date").parquet(f"{path}/{ENTRY_FILES}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries that are complete; the day column serves pruning."""
    return valid_entries(_entries(spark, path)).drop("batch")


def read_rollup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The sums of all batches, by day (``DAY_FILES``) or by day and label (``LABEL_FILES``)."""
    schema = {LABEL_FILES: LABELS_SCHEMA, DAY_FILES: DAYS_SCHEMA}[name]
    if _missing(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")


def retain_log(spark: SparkSession, path: str, n: int = MAX_LOG_ENTRIES) -> DataFrame:
    """Cut a stored log to its newest ``n`` entries and return them.

    The sums by day say how many days these take; older days are dropped unread,
    and of the oldest kept only that day is written anew.
    """
    newest = Window.orderBy(F.desc("day"))
    per_day = read_rollup(spark, path, DAY_FILES).groupBy("day").agg(F.sum("incidents").alias("n"))
    # A row for each day of the calendar that has entries.
    so_far = per_day.withColumn("so_far", F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    cut = so_far.filter(F.col("so_far") >= n).agg(F.max("day")).first()[0]
    if cut is None:
        return retain(read_log(spark, path), n)
    recent = read_log(spark, path).filter(F.col("day") >= F.lit(cut))
    kept = stored(retain(recent, n).withColumn("batch", F.lit("retained")), "retained")
    oldest = f"{path}/{ENTRY_FILES}/day={cut}"
    kept.filter(F.col("day") == F.lit(cut)).drop("day").coalesce(1).write.mode("overwrite").parquet(oldest)
    for old in _days_before(spark, path, str(cut)):
        _delete(spark, old)
    sums = stored(label_sums(kept), "kept-labels"), stored(day_sums(kept), "kept-days")
    for name, df in zip((LABEL_FILES, DAY_FILES), sums):
        _delete(spark, f"{path}/{name}")
        df.withColumn("batch", F.lit("retained")).coalesce(1).write.parquet(f"{path}/{name}/retained")
    return kept.drop("batch")


def _days_before(spark: SparkSession, path: str, day: str) -> list[str]:
    """The folders of earlier days; one for each day of the calendar at most."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ENTRY_FILES}")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [status.getPath().getName() for status in found]
    return [f"{path}/{ENTRY_FILES}/{name}" for name in names if name.startswith("day=") and name[4:] < day]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# The field names of a stored entry.
STORED_NAMES = {
    "id": "id", "timestamp": "ts", "hostname": "hostname", "siteLabel": "site_label", "action": "action",
    "totalFindings": "total_findings", "secrets": "secrets", "pii": "pii", "ruleLabels": "rule_labels",
    "trigger": "trigger", "mode": "mode", "note": "note",
}


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON lines; those that lack a field, or have it with the wrong type, are dropped."""
    return parse_log(spark.read.text(path), "value")


def parse_log(df: DataFrame, json_col: str) -> DataFrame:
    """Entries held as JSON text in a column; see :func:`read_log_json`."""
    entry = F.col("entry")
    get = {"total_findings": typed.number, "secrets": typed.number, "pii": typed.number}
    fields = {column: get.get(column, typed.text)(entry, name) for name, column in STORED_NAMES.items()}
    # The labels have to be a list; what it lists is taken as text.
    labels = typed.items(entry, "ruleLabels")
    fields["rule_labels"] = F.transform(labels, lambda x: F.try_variant_get(x, "$", "string"))
    fields["ts"] = fields["ts"].try_cast("timestamp")
    read = df.select(typed.parsed(F.col(json_col)).alias("entry"))
    return valid_entries(read.select(*(value.alias(column) for column, value in fields.items())))


def write_log_json(log: DataFrame, path: str) -> None:
    """Entries as JSON lines under their stored names."""
    log.withColumnsRenamed({column: name for name, column in STORED_NAMES.items()}).write.json(path)


def clear_log(spark: SparkSession, path: str) -> None:
    """Empty the log and its rollups; batches that were complete stay so, and are not added again."""
    for name in (LABEL_FILES, DAY_FILES):
        _delete(spark, f"{path}/{name}")
    empty = spark.createDataFrame([], LOG_SCHEMA + ", batch string, day date")
    empty.write.mode("overwrite").parquet(f"{path}/{ENTRY_FILES}")

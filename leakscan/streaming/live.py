"""The live path: scanning texts as they arrive.

The scan is row-local, so the batch column plan runs unchanged on a stream and
keeps no state.  Policy tables are read again in every micro-batch when they
come from a function (``policy_source``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leakscan.functions.text import mask_snippet
from leakscan.operators.allow import any_crowded
from leakscan.operators.attachments import is_text_like, latest_selection
from leakscan.operators.detect import scan
from leakscan.operators.policy import SITES, Policy, guarded, guarded_as_of
from leakscan.sources.shared import shared_folder, stored


def read_stream(spark: SparkSession, folder: str, file_glob: str, schema, max_files: int | None = None) -> DataFrame:
    """Texts from parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The texts of one table among others in a folder, as they appear: in its one file, or in a folder of files."""
    path = f"{folder}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(where) and system.getFileStatus(where).isDirectory():
        return read_stream(spark, path, "*", schema)
    return read_stream(spark, folder, f"{name}.parquet", schema)


def scan_stream(texts: DataFrame, policy: Policy, versions: DataFrame | None = None, **scan_options) -> DataFrame:
    """Scan arriving texts on guarded hosts, each by the switches of its origin.

    With ``versions`` (:func:`policy.profile_versions`) the profile of a host is
    the one that held at the text's own ``ts``.  Exact allow rules are joined
    within the stream, as a static table, of which each text carries those of its
    host: ``scan_to_table`` is for any number of them.

    A pasted text counts as composer text in its findings.  The content of a
    file stays marked as such, so that nothing rewrites it, and its findings
    keep a masked preview in place of the match, as those of ``scan_files`` do;
    where texts have a ``file_name`` and a ``file_type``, only files that look
    like text are scanned.
    """
    if versions is None:
        on = guarded(texts, policy, origin_col="origin")
    else:
        on = guarded_as_of(texts, policy, versions, origin_col="origin")
        scan_options["strictness"] = F.col("profile.strictness")
    attached = F.col("origin") == "attachment"
    if {"file_name", "file_type"} <= set(texts.columns):
        on = on.filter(~attached | is_text_like(F.col("file_name"), F.col("file_type")))
    origin = F.when(attached, F.lit("attachment")).otherwise(F.lit("composer"))
    scanned = scan(on, policy, host_col="hostname", origin=origin, **scan_options)
    return scanned.withColumn(
        "findings", F.when(attached, F.transform("findings", _masked)).otherwise(F.col("findings"))
    )


def _masked(f: Column) -> Column:
    none = F.lit(None).cast("int")
    preview = mask_snippet(f.match)
    out = f.withField("match", preview).withField("snippet", preview).withField("start_pos", none)
    return out.withField("end_pos", none).withField("allow_fingerprint", F.lit(None).cast("string"))


def write_available(
    rows: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Append everything that has arrived to a parquet table, then stop."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def run_to_table(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over what has arrived and read back the table it wrote."""
    folder = shared_folder(spark, name)
    query = write_available(rows, f"{folder}/table", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")


def scan_with_reload(
    texts: DataFrame,
    policy_source: Callable[[SparkSession], Policy],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    **scan_options,
) -> StreamingQuery:
    """Scan a stream with a policy that is read again for every micro-batch.

    ``write`` gets the scanned batch and its number; writing under that number
    keeps a batch that is run again from being stored twice.  Each batch is an
    ordinary table, so exact allow rules of any number can be joined with it.
    """
    def each(batch: DataFrame, number: int) -> None:
        write(scan_stream(batch, policy_source(batch.sparkSession), **scan_options), number)

    return (
        texts.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scan_to_table(
    spark: SparkSession, texts: DataFrame, policy: Policy, rows: Callable[[DataFrame], DataFrame], name: str, **scan_options
) -> DataFrame:
    """Scan what has arrived on a stream and read back the table of ``rows`` of the scanned texts.

    Exact allow rules are joined within the stream's plan while they are few
    enough to ride along.  Beyond that each micro-batch is scanned as a table and
    its findings are joined with the rules by what they have to agree on; a batch
    that runs again replaces its part.
    """
    scanned = rows(scan_stream(texts, policy, **scan_options))
    allow, timed = policy.exact_allow, scan_options.get("at") is not None
    if allow is None or not any_crowded(allow.filter(F.col("hostname").isin(list(SITES))), ["hostname"], scan_options.get("as_of"), timed):
        return run_to_table(spark, scanned, name)
    # Read in every micro-batch.
    policy = replace(policy, exact_allow=stored(allow, f"{name}-rules"))
    folder = shared_folder(spark, name)
    write = write_numbered(f"{folder}/table")
    query = scan_with_reload(
        texts, lambda _: policy, lambda batch, number: write(rows(batch), number), f"{folder}/checkpoint", **scan_options
    )
    query.awaitTermination()
    if not count_files(spark, f"{folder}/table"):
        return spark.createDataFrame([], scanned.schema)
    return spark.read.schema(scanned.schema).parquet(f"{folder}/table").select(*scanned.columns)


def write_numbered(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for ``scan_with_reload``: one folder per micro-batch, replaced on a rerun."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def reload_when_changed(
    version: Callable[[SparkSession], object], load: Callable[[SparkSession], Policy]
) -> Callable[[SparkSession], Policy]:
    """A policy source that loads, and compiles its rules, only when the version is a new one."""
    held: dict = {}

    def source(spark: SparkSession) -> Policy:
        now = version(spark)
        if "policy" not in held or held["version"] != now:
            held.update(version=now, policy=load(spark))
        return held["policy"]

    return source


def record_selections(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that appends the file selections of a micro-batch to a change log.

    A batch holds one row per selected file, with its findings and without its
    text, or one with a null ``file_name`` for a selection of no file.  Nothing
    that was written is read or written again; a batch that runs again replaces
    its own part.
    """
    def write(batch: DataFrame, number: int) -> None:
        # Both parts come from the rows as stored: a batch is scanned once.
        spark, scanned = batch.sparkSession, f"{path}/scanned/batch={number}"
        batch.write.mode("overwrite").parquet(scanned)
        rows = spark.read.schema(batch.schema).parquet(scanned)
        made = rows.select("input_id", "batch_ts").distinct()
        made.write.mode("overwrite").parquet(f"{path}/selections/batch={number}")
        files = rows.filter(F.col("file_name").isNotNull() & (F.size("findings") > 0))
        files.write.mode("overwrite").parquet(f"{path}/files/batch={number}")
        _drop(spark, scanned)

    return write


SNAPSHOT = "snapshot"


def _parts(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the complete folders ``prefix<number>`` in a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [status.getPath().getName() for status in system.listStatus(root)]
    done = [n for n in names if n.startswith(prefix) and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(prefix)) for n in done)


def count_files(spark: SparkSession, path: str) -> int:
    """How many files of rows a folder holds; none if it does not exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(root)] if system.exists(root) else []
    return sum(not name.startswith(("_", ".")) for name in names)


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _selections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Selections and flagged files as the newest snapshot and the later batches have them, and the numbers of both."""
    snapshots = _parts(spark, f"{path}/{SNAPSHOT}/selections", "upto=")
    upto = snapshots[-1] if snapshots else -1
    batches = [n for n in _parts(spark, f"{path}/files", "batch=") if n > upto]
    found = []
    for name in ("selections", "files"):
        places = [f"{path}/{name}/batch={n}" for n in batches]
        if snapshots:
            places.insert(0, f"{path}/{SNAPSHOT}/{name}/upto={upto}")
        found.append(spark.read.parquet(*places))
    return *found, upto, batches[-1] if batches else upto


def pending_selections(spark: SparkSession, path: str) -> DataFrame:
    """The flagged files of each input's last selection; a selection of no file leaves none."""
    selections, files, _, _ = _selections(spark, path)
    return latest_selection(files, selections)


def compact_selections(spark: SparkSession, path: str, forget_after: timedelta | None = None) -> int:
    """Fold the change log into a snapshot, one generation on; returns the last batch that it covers.

    The snapshot has each input's last selection and that selection's files.  An
    input whose last selection is empty leaves only the time of it, so that an
    older one that comes late does not bring files back, and nothing once that
    time is ``forget_after`` before the newest.  Batches that the snapshot covers
    and older snapshots are deleted after it is complete: a compaction that is
    cut short changes nothing, and runs again.
    """
    selections, files, upto, last = _selections(spark, path)
    if last == upto:
        return upto
    newest = selections.groupBy("input_id").agg(F.max("batch_ts").alias("batch_ts"))
    kept = latest_selection(files, selections)
    if forget_after is not None:
        # One row: the newest time of all.
        horizon = newest.agg(F.max("batch_ts")).first()[0] - forget_after
        live = kept.select("input_id").distinct().withColumn("live", F.lit(True))
        newest = newest.join(live, "input_id", "left").filter((F.col("batch_ts") >= F.lit(horizon)) | F.col("live")).drop("live")
    kept.write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}/files/upto={last}")
    newest.write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}/selections/upto={last}")
    for name in ("selections", "files"):
        for n in _parts(spark, f"{path}/{name}", "batch="):
            if n <= last:
                _drop(spark, f"{path}/{name}/batch={n}")
        for n in _parts(spark, f"{path}/{SNAPSHOT}/{name}", "upto="):
            if n < last:
                _drop(spark, f"{path}/{SNAPSHOT}/{name}/upto={n}")
    return last


def merge_by_key(path: str, key: str, newer) -> Callable[[DataFrame, int], None]:
    """A writer for a stream in update mode: the rows of each micro-batch replace those of their key in a table.

    ``newer`` orders the rows of a key, so that one that comes late does not take
    the place of a newer one.  Each micro-batch makes a folder of its own, complete
    or not there; a batch that runs again finds its own.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _parts(spark, path, "upto=")
        if number in done:
            return
        rows = batch if not done else batch.unionByName(spark.read.parquet(f"{path}/upto={done[-1]}"))
        others = [c for c in batch.columns if c != key]
        best = rows.groupBy(key).agg(F.max_by(F.struct(*others), newer).alias("row")).select(key, "row.*")
        best.write.mode("overwrite").parquet(f"{path}/upto={number}")
        for n in done:
            _drop(spark, f"{path}/upto={n}")

    return write


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last complete micro-batch left it."""
    return spark.read.parquet(f"{path}/upto={_parts(spark, path, 'upto=')[-1]}")


def last_scans(scans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the newest scan of each host, from a stream of (hostname, scan_type, total, ts, scan_id)."""
    last = F.max_by(F.struct("scan_type", "total", "ts", "scan_id"), F.struct("ts", "scan_id")).alias("last")
    rows = scans.groupBy("hostname").agg(last).select("hostname", "last.*")
    write = merge_by_key(path, "hostname", F.struct("ts", "scan_id"))
    return (
        rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

"""Scanning attached files, and keeping track of what they still hold.

Files have the columns ``input_id, batch_ts, file_name, file_type, size, mtime,
text``; a *scope* is one selection of files, by one input at one time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions.text import is_blank, mask_snippet
from leakscan.operators.detect import scan
from leakscan.operators.policy import Policy

# Fixed values.
TEXT_EXTENSIONS = (".txt", ".md", ".json", ".env", ".csv", ".yaml", ".yml", ".log")
DEFAULT_TYPE = "text/plain"
MAX_FILE_CHARS = 250_000  # a limit that a caller may ask for

SCOPE = ("input_id", "batch_ts")


def is_text_like(file_name: Column, file_type: Column) -> Column:
    """A text MIME type, or one of the known extensions."""
    test = F.coalesce(file_type.startswith("text/"), F.lit(False))
    lowered = F.lower(file_name)
    for extension in TEXT_EXTENSIONS:
        test = test | lowered.endswith(extension)
    return test


def scannable(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Text-like files that are not blank, whole unless ``max_chars`` cuts them."""
    kept = files.filter(is_text_like(F.col("file_name"), F.col("file_type"))).filter(~is_blank(F.col("text")))
    return kept if max_chars is None else kept.withColumn("text", F.substring("text", 1, max_chars))


def file_key(*scope: str) -> Column:
    """Identifies one file of one selection."""
    return F.concat_ws(
        ":",
        *(F.col(c).cast("string") for c in scope),
        "file_name",
        F.col("size").cast("string"),
        F.unix_millis("mtime").cast("string"),
    )


def scan_files(
    files: DataFrame, policy: Policy | None = None, *, host_col: str | None = None,
    as_of: datetime | None = None, scope: tuple[str, ...] = SCOPE, max_chars: int | None = None,
) -> DataFrame:
    """Scan each file; files without findings are left out.

    The findings of a file carry a masked preview, never the match itself nor
    its position.
    """
    scanned = scan(scannable(files, max_chars), policy, host_col=host_col, origin="attachment", as_of=as_of)
    kind = F.coalesce(F.nullif("file_type", F.lit("")), F.lit(DEFAULT_TYPE))

    def reported(f: Column) -> Column:
        return F.struct(
            F.sha2(
                F.concat_ws(
                    ":", F.col("file_key"), f.rule_id, f.start_pos.cast("string"), f.end_pos.cast("string")
                ),
                256,
            ).alias("finding_id"),
            F.col("file_name").alias("file_name"),
            F.col("file_type").alias("file_type"),
            f.rule_id.alias("rule_id"),
            f.label.alias("label"),
            f.category.alias("category"),
            f.severity.alias("severity"),
            f.source.alias("source"),
            mask_snippet(f.match).alias("match_preview"),
            f.placeholder.alias("placeholder"),
            f.explanation.alias("explanation"),
            f.confidence.alias("confidence"),
            f.confidence_label.alias("confidence_label"),
            f.why.alias("why"),
            f.allow_fingerprint.alias("allow_fingerprint"),
        )

    flagged = scanned.filter(F.size("findings") > 0).drop("text")
    return flagged.withColumns({"file_key": file_key(*scope), "file_type": kind}).withColumn(
        "findings", F.transform("findings", reported)
    )


def latest_selection(
    rows: DataFrame, selections: DataFrame | None = None, key: str = "input_id", ts: str = "batch_ts"
) -> DataFrame:
    """The rows that belong to each input's last selection.

    ``selections`` lists every selection made; give it when ``rows`` has lost
    some, as scanned files have (a newer selection without findings still
    replaces an older one).  Finding the newest time reads two columns and
    aggregates map-side.  The semi join is on both columns, so AQE can split
    the side on which one input holds most of the rows, which a window over
    the input could not.
    """
    newest = (rows if selections is None else selections).groupBy(key).agg(F.max(ts).alias(ts))
    return rows.join(newest, [key, ts], "left_semi")


def batch_totals(scanned_files: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Findings per selection, with the labels in the order first met."""
    def count(category: str) -> Column:
        return F.size(F.filter("findings", lambda f: f.category == category))

    rows = scanned_files.select(
        *scope,
        F.struct("file_key").alias("source_order"),
        F.transform("findings", lambda f: f.label).alias("labels"),
        F.size("findings").alias("total_findings"),
        count("secret").alias("secrets"),
        count("pii").alias("pii"),
    )
    return totals(rows, scope, ("total_findings", "secrets", "pii"))


def totals(rows: DataFrame, key: tuple[str, ...], counters: tuple[str, ...]) -> DataFrame:
    """Sum ``counters`` per key and list its distinct ``labels`` in ``rule_labels``.

    Labels are ordered by ``source_order``, then position.  One pass over the
    rows: they are reduced to one per key and label before the shuffle, each
    row's counters riding on its first label.  A key that holds most of the
    rows leaves each task as a few rows, and what is collected per key is
    bounded by the number of rules.
    """
    exploded = rows.select(*key, "source_order", *counters, F.posexplode("labels").alias("pos", "label"))
    per_label = exploded.groupBy(*key, "label").agg(
        F.min(F.struct("source_order", "pos")).alias("first"),
        *(F.sum(F.when(F.col("pos") == 0, F.col(c)).otherwise(0)).alias(c) for c in counters),
    )
    return per_label.groupBy(*key).agg(
        *(F.sum(c).alias(c) for c in counters),
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x.label
        ).alias("rule_labels"),
    )


def pending_after(scanned_files: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings left per file once the allowed ones are taken out.

    Files with nothing left drop out.  ``allowed`` holds ``finding_id``.
    """
    others = [c for c in scanned_files.columns if c != "findings"]
    rows = scanned_files.select(*others, F.inline(F.transform("findings", lambda f: F.struct(f.alias("finding")))))
    left = rows.join(
        allowed.select("finding_id").distinct(), F.col("finding.finding_id") == F.col("finding_id"), "left_anti"
    )
    return left.groupBy("file_key").agg(
        F.first("file_name").alias("file_name"),
        F.count(F.lit(1)).alias("pending"),
        F.sum(F.when(F.col("finding.category") == "secret", 1).otherwise(0)).alias("secrets"),
        F.sum(F.when(F.col("finding.category") == "pii", 1).otherwise(0)).alias("pii"),
    )

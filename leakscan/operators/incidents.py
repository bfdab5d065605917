"""The incident log and what is reported from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.operators.attachments import totals
from leakscan.operators.detect import summarize
from leakscan.operators.policy import moment, site_label
from leakscan.sources.shared import stored

# Fixed values.
MAX_LOG_ENTRIES = 150
RECENT = 6
NONE_YET = "None yet"
REQUIRED = (
    "id", "ts", "hostname", "site_label", "action", "total_findings", "secrets", "pii", "rule_labels", "trigger",
)
NOTES = {
    "cancelled": "The user canceled after reviewing the findings.",
    "allowlisted": "Current findings were allowlisted for this site before send.",
    "ignored_once": "The user chose to ignore the warning once and send original content.",
    "pasted_flagged": "The scanner flagged pasted text before send.",
    "attachment_flagged": "The scanner found potential issues in an attached file.",
}
REWRITE_NOTE = "Composer text was rewritten before send."
REWRITE_NOTE_FILES = (
    "Composer text was rewritten before send. Attachments remained unchanged after review."
)

LOG_SCHEMA = (
    "id string, ts timestamp, hostname string, site_label string, action string, "
    "total_findings bigint, secrets bigint, pii bigint, rule_labels array<string>, "
    "trigger string, mode string, note string"
)


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("id")]


def event_counts(composer: DataFrame, attachments: DataFrame, key: str) -> DataFrame:
    """Findings per event over its composer text and its files together.

    ``composer`` and ``attachments`` hold ``findings``.  Both sides are cut to
    counts and labels before they shuffle; the texts do not travel.
    """
    def side(df: DataFrame, rank: int, order: Column) -> DataFrame:
        s = df.select(key, order.alias("within"), summarize(F.col("findings")).alias("s")).filter("s.total > 0")
        return s.select(
            key,
            F.struct(F.lit(rank).alias("side"), "within").alias("source_order"),
            F.col("s.rule_labels").alias("labels"),
            F.col("s.total").alias("total_findings"),
            "s.secrets",
            "s.pii",
            F.lit(0 if rank == 0 else 1).alias("files"),
        )

    files = attachments.withColumn("findings", F.transform("findings", _as_summary_input))
    both = side(composer, 0, F.lit("")).unionByName(side(files, 1, F.col("file_key")))
    return totals(both, (key,), ("total_findings", "secrets", "pii", "files"))


def _as_summary_input(f: Column) -> Column:
    return F.struct(
        f.category.alias("category"), f.severity.alias("severity"),
        f.confidence_label.alias("confidence_label"), f.label.alias("label"),
    )


def note_for(action: Column, flagged_files: Column) -> Column:
    notes = F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))
    rewritten = F.when(flagged_files > 0, F.lit(REWRITE_NOTE_FILES)).otherwise(F.lit(REWRITE_NOTE))
    return F.coalesce(notes[action], rewritten)


def log_entries(counts: DataFrame, *id_from: str) -> DataFrame:
    """Log rows from counted events (``hostname, ts, action, trigger, mode`` known)."""
    identity = [F.unix_micros("ts").cast("string"), F.col("hostname"), F.col("action")]
    return counts.select(
        F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in id_from), *identity), 256).alias("id"),
        "ts",
        "hostname",
        site_label(F.col("hostname")).alias("site_label"),
        "action",
        F.col("total_findings").cast("bigint").alias("total_findings"),
        F.col("secrets").cast("bigint").alias("secrets"),
        F.col("pii").cast("bigint").alias("pii"),
        F.array_distinct(F.coalesce("rule_labels", F.array().cast("array<string>"))).alias("rule_labels"),
        "trigger",
        F.coalesce("mode", F.lit("none")).alias("mode"),
        note_for(F.col("action"), F.coalesce("files", F.lit(0))).alias("note"),
    )


def valid_entries(log: DataFrame) -> DataFrame:
    """Entries with every required field."""
    return log.dropna(subset=list(REQUIRED))


def retain(log: DataFrame, n: int = MAX_LOG_ENTRIES) -> DataFrame:
    """The newest entries."""
    return log.orderBy(*newest_first()).limit(n)


def count_last_days(log: DataFrame, days: int, as_of: datetime | None = None) -> DataFrame:
    """Entries of the last days; of a log stored by day only those days are read."""
    cutoff = F.timestamp_add("HOUR", F.lit(-24 * days), moment(as_of))
    if "day" in log.columns:
        # A day of room, for a log that was written in another time zone.
        log = log.filter(F.col("day") >= F.date_sub(F.to_date(cutoff), 1))
    return log.filter(F.col("ts") >= cutoff).agg(F.count(F.lit(1)).alias("incidents"))


def label_sums(log: DataFrame) -> DataFrame:
    """Per day and label of a log with ``day``: entries, and which of them is met first, newest entry first.

    Sums of parts of a log add up to those of the whole, see :func:`top_label`.
    """
    labels = valid_entries(log).select("day", (-F.unix_micros("ts")).alias("age"), "id", F.posexplode("rule_labels").alias("pos", "label"))
    # Counts and newest times are numbers, which aggregate by hash; ids and places are compared only where these tie.
    # Stored, their size is known: the log itself is shuffled only if there are very many days and labels.
    counted = stored(
        labels.groupBy("day", "label").agg(F.count(F.lit(1)).alias("entries"), F.min("age").alias("age")), "label-counts"
    )
    tied = labels.join(counted, ["day", "label", "age"])
    ids = tied.groupBy("day", "label", "entries", "age").agg(F.min(F.struct("id", "pos")).alias("first"))
    return ids.select("label", "entries", "age", "first.id", "first.pos", "day")


def day_sums(log: DataFrame) -> DataFrame:
    """Per day of a log with ``day``: entries, secrets and personal data."""
    sums = valid_entries(log).groupBy("day").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("secrets").alias("secrets"), F.sum("pii").alias("pii")
    )
    return sums.select("incidents", "secrets", "pii", "day")


def top_label(sums: DataFrame) -> DataFrame:
    """The label in most entries; on a tie, the one met first, newest entry first.  ``sums`` are those of any days."""
    counted = sums.groupBy("label").agg(F.sum("entries").alias("total"), F.min("age").alias("age"))
    best = counted.orderBy(F.desc("total"), "age").limit(1).select("total", "age")
    tied = counted.join(best, ["total", "age"]).select("label", "age")
    first = sums.join(tied, ["label", "age"]).orderBy("id", "pos").limit(1)
    return first.agg(F.coalesce(F.max("label"), F.lit(NONE_YET)).alias("top_rule"))


def top_rule(log: DataFrame) -> DataFrame:
    """The label in most entries of a log; see :func:`top_label`."""
    return top_label(label_sums(log.withColumn("day", F.to_date("ts"))))


def top_category(log: DataFrame) -> DataFrame:
    sums = log.agg(
        F.coalesce(F.sum("secrets"), F.lit(0)).alias("secrets"), F.coalesce(F.sum("pii"), F.lit(0)).alias("pii")
    )
    return sums.select(
        F.when((F.col("secrets") == 0) & (F.col("pii") == 0), F.lit(NONE_YET))
        .when(F.col("secrets") >= F.col("pii"), F.lit("Secrets"))
        .otherwise(F.lit("PII"))
        .alias("top_category")
    )


def recent(log: DataFrame, n: int = RECENT) -> DataFrame:
    return log.orderBy(*newest_first()).limit(n)


def review_counters(key: str, *sides: DataFrame) -> DataFrame:
    """Secrets, personal data and total per event, over every kind of finding."""
    rows = None
    for df in sides:
        s = df.select(
            key,
            F.size("findings").alias("total"),
            F.size(F.filter("findings", lambda f: f.category == "secret")).alias("secrets"),
            F.size(F.filter("findings", lambda f: f.category == "pii")).alias("pii"),
        )
        rows = s if rows is None else rows.unionByName(s)
    return rows.groupBy(key).agg(
        F.sum("total").alias("total"), F.sum("secrets").alias("secrets"), F.sum("pii").alias("pii")
    )


def last_scan(scans: DataFrame) -> DataFrame:
    """The newest scan per host (``hostname, scan_type, total, ts, scan_id``)."""
    newest = F.max_by(F.struct("scan_type", "total", "ts"), F.struct("ts", "scan_id"))
    return scans.groupBy("hostname").agg(newest.alias("last")).select("hostname", "last.*")

"""Registered queries: texts and files in, incident log, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators import attachments as att
from leakscan.operators import chunks, detect
from leakscan.operators import incidents as inc
from leakscan.operators import policy as pol
from leakscan.plans import oracle as o
from leakscan.plans import settings as st
from leakscan.plans.inputs import for_duckdb, for_spark
from leakscan.plans.policies import ACTION_SQL, HOSTS_SQL, NOW_SQL
from leakscan.plans.registry import query
from leakscan.sources import files as files_source
from leakscan.sources import logs
from leakscan.sources.shared import shared_folder, stored, versioned_folder
from leakscan.sources.tables import composer_texts

# --- sources -----------------------------------------------------------------


@query(
    "src_documents",
    f"""SELECT doc_id, replace(text, chr(160), ' ') AS text FROM ({for_duckdb('typed')})
        WHERE length(regexp_replace(replace(text, chr(160), ' '), '\\s', '', 'g')) > 0""",
)
def src_documents(spark, sf):
    return composer_texts(for_spark(spark, sf, "typed"))


_TEXT_LIKE = (
    "(coalesce(file_type LIKE 'text/%', false) OR regexp_matches(lower(file_name), "
    "'\\.(txt|md|json|env|csv|yaml|yml|log)$'))"
)


@query(
    "attachment_gate",
    f"SELECT doc_id, file_name, file_type, {_TEXT_LIKE} AS text_like FROM ({for_duckdb('files')})",
)
def attachment_gate(spark, sf):
    return for_spark(spark, sf, "files").select(
        "doc_id", "file_name", "file_type", att.is_text_like(F.col("file_name"), F.col("file_type")).alias("text_like")
    )


@query(
    "attachment_truncate",
    f"""SELECT doc_id, length(left(text, 250000)) AS n_chars, md5(left(text, 250000)) AS text_md5
        FROM ({for_duckdb('long_files')}) WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0""",
)
def attachment_truncate(spark, sf):
    cut = att.scannable(for_spark(spark, sf, "long_files"), att.MAX_FILE_CHARS)
    return st.bigints(cut.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")))


# --- files -------------------------------------------------------------------

_FILES_SQL = f"""files AS ({for_duckdb('files')}),
found AS (
  WITH {o.resolved(f"SELECT doc_id, text FROM ({for_duckdb('files')}) WHERE {_TEXT_LIKE}",
                   'doc_id')}
  SELECT f.*, {o.mask_snippet('m')} AS preview FROM f),
rows AS (
  SELECT found.*, input_id, batch_ts, file_name, coalesce(nullif(file_type, ''), 'text/plain') AS file_type,
    concat_ws(':', input_id, CAST(batch_ts AS VARCHAR), file_name, size, epoch_ms(mtime)) AS file_key
  FROM found JOIN files USING (doc_id))"""


def scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    return att.scan_files(for_spark(spark, sf, "files"))


@query(
    "attachment_findings",
    f"""WITH {_FILES_SQL} SELECT file_key, sha256(concat_ws(':', file_key, rule_id, s, e)) AS finding_id, file_name,
        file_type, rule_id, label, category, sev AS severity, preview AS match_preview,
        CAST(conf AS BIGINT) AS confidence, why, fingerprint AS allow_fingerprint FROM rows""",
)
def attachment_findings(spark, sf):
    found = scanned_files(spark, sf).select("file_key", F.inline("findings"))
    return st.bigints(
        found.select(
            "file_key", "finding_id", "file_name", "file_type", "rule_id", "label", "category", "severity",
            "match_preview", "confidence", F.array_join("why", "|").alias("why"), "allow_fingerprint",
        )
    )


@query(
    "attachment_batch_log",
    f"""WITH {_FILES_SQL}, counts AS (
          SELECT input_id, batch_ts, count(*) AS total_findings, count(*) FILTER (category = 'secret') AS secrets,
            count(*) FILTER (category = 'pii') AS pii FROM rows GROUP BY input_id, batch_ts),
        labels AS (
          SELECT input_id, batch_ts, string_agg(label, '|' ORDER BY first) AS rule_labels FROM (
            SELECT input_id, batch_ts, label, min({{'k': file_key, 's': s}}) AS first FROM rows GROUP BY ALL)
          GROUP BY ALL)
        SELECT input_id, epoch_us(batch_ts) AS batch_ts, total_findings, secrets, pii, rule_labels,
          'attachment_flagged' AS action FROM counts JOIN labels USING (input_id, batch_ts)""",
)
def attachment_batch_log(spark, sf):
    totals = att.batch_totals(scanned_files(spark, sf))
    return totals.select(
        "input_id", F.unix_micros("batch_ts").alias("batch_ts"), "total_findings", "secrets", "pii",
        F.array_join("rule_labels", "|").alias("rule_labels"), F.lit("attachment_flagged").alias("action"),
    )


@query(
    "attachment_latest",
    f"""WITH {_FILES_SQL} SELECT input_id, file_key, count(*) AS findings FROM rows
        JOIN (SELECT input_id, max(batch_ts) AS batch_ts FROM files GROUP BY input_id) USING (input_id, batch_ts)
        GROUP BY ALL""",
)
def attachment_latest(spark, sf):
    # Files of selections that were replaced are not scanned.
    latest = att.scan_files(att.latest_selection(for_spark(spark, sf, "files")))
    return st.bigints(latest.select("input_id", "file_key", F.size("findings").alias("findings")))


@query(
    "scan_file_source",
    f"""WITH {o.resolved(f"SELECT doc_id // 64 AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM ({for_duckdb('seeded')}) GROUP BY doc_id // 64", 'doc_id')}
        SELECT doc_id AS folder, rule_id, {o.mask_snippet('m')} AS match_preview, CAST(conf AS BIGINT) AS confidence FROM f""",
)
def scan_file_source(spark, sf):
    """Documents written as text files, 64 to a file, and scanned as one selection of files."""
    folder = shared_folder(spark, "files")
    texts = for_spark(spark, sf, "seeded").select(F.expr("doc_id div 64").alias("folder"), "doc_id", "text")
    dealt = texts.repartition("folder").sortWithinPartitions("folder", "doc_id").drop("doc_id")
    dealt.write.partitionBy("folder").text(folder)
    files = files_source.read_files(spark, folder, input_id="upload", batch_ts=st.NOW)
    name = F.regexp_extract("path", r"folder=(\d+)/", 1).cast("bigint").alias("folder")
    found = att.scan_files(files).select(name, F.inline("findings"))
    return st.bigints(found.select("folder", "rule_id", "match_preview", "confidence"))


_BY_64 = (
    "SELECT doc_id // 64 AS folder, string_agg(text, chr(10) ORDER BY doc_id) AS text "
    f"FROM ({for_duckdb('seeded')}) GROUP BY doc_id // 64"
)
_LONG_SQL = f"""WITH {o.resolved(_BY_64, 'folder')} SELECT folder, rule_id, s AS start_pos, e AS end_pos, m AS match,
  CAST(conf AS BIGINT) AS confidence FROM f"""
_LONG = ("folder", "rule_id", "start_pos", "end_pos", "match", "confidence")


@query("scan_long_texts", _LONG_SQL)
def scan_long_texts(spark, sf):
    """Texts of 64 documents each, scanned in chunks of 8,000 characters."""
    lines = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    texts = for_spark(spark, sf, "seeded").groupBy(F.expr("doc_id div 64").alias("folder")).agg(
        F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text")
    )
    scanned = chunks.scan_long(texts, ("folder",), size=8000)
    return st.bigints(scanned.select("folder", F.inline("findings")).select(*_LONG))


@query("scan_long_files", _LONG_SQL)
def scan_long_files(spark, sf):
    """The same texts as files, read and scanned in chunks."""
    folder = shared_folder(spark, "long-files")
    texts = for_spark(spark, sf, "seeded").select(F.expr("doc_id div 64").alias("folder"), "doc_id", "text")
    dealt = texts.repartition("folder").sortWithinPartitions("folder", "doc_id").drop("doc_id")
    dealt.write.partitionBy("folder").text(folder)
    scanned = chunks.scan_chunks(files_source.read_chunks(spark, folder, size=30_000), ("path",))
    name = F.regexp_extract("path", r"folder=(\d+)/", 1).cast("bigint").alias("folder")
    return st.bigints(scanned.select(name, F.inline("findings")).select(*_LONG))


@query(
    "attachment_pending",
    f"""WITH {_FILES_SQL} SELECT file_key, file_name, count(*) AS pending,
          count(*) FILTER (category = 'secret') AS secrets, count(*) FILTER (category = 'pii') AS pii
        FROM rows WHERE rule_id NOT IN ('email', 'kv-secret-value') GROUP BY ALL""",
)
def attachment_pending(spark, sf):
    files = stored(scanned_files(spark, sf), "flagged-files")
    allowed = files.select(F.inline("findings")).filter(F.col("rule_id").isin("email", "kv-secret-value"))
    return att.pending_after(files, allowed)


@query(
    "attachment_pending_total",
    f"WITH {_FILES_SQL} SELECT count(*) AS pending_flags, count(DISTINCT file_key) AS files FROM rows",
)
def attachment_pending_total(spark, sf):
    files = scanned_files(spark, sf)
    return files.agg(
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("pending_flags"),
        F.countDistinct("file_key").alias("files"),
    )


# --- the incident log --------------------------------------------------------

_LOG_SQL = f"""composer AS (
  WITH {o.resolved(for_duckdb('sent'), 'event_id')}
  SELECT event_id, 0 AS side, label, category, s FROM f),
attached AS (
  WITH {o.resolved(for_duckdb('event_files'), 'event_id')}
  SELECT event_id, 1 AS side, label, category, s FROM f),
hits AS (SELECT * FROM composer UNION ALL SELECT * FROM attached),
counts AS (
  SELECT event_id, count(*) AS total_findings, count(*) FILTER (category = 'secret') AS secrets,
    count(*) FILTER (category = 'pii') AS pii, count(*) FILTER (side = 1) AS in_files FROM hits GROUP BY event_id),
labels AS (
  SELECT event_id, string_agg(label, '|' ORDER BY first) AS rule_labels FROM (
    SELECT event_id, label, min(side * 1000000000 + s) AS first FROM hits GROUP BY ALL) GROUP BY event_id),
acted AS (SELECT *, {ACTION_SQL} AS action FROM ({for_duckdb('decisions')})),
{HOSTS_SQL},
log AS (
  SELECT sha256(concat_ws(':', event_id, epoch_us(ts), hostname, action)) AS id, ts, hostname, site AS site_label,
    action, total_findings, secrets, pii, rule_labels, 'send' AS trigger_name, coalesce(mode, 'none') AS mode,
    CASE action WHEN 'cancelled' THEN 'The user canceled after reviewing the findings.'
      WHEN 'allowlisted' THEN 'Current findings were allowlisted for this site before send.'
      WHEN 'ignored_once' THEN 'The user chose to ignore the warning once and send original content.'
      ELSE 'Composer text was rewritten before send.'
        || CASE WHEN in_files > 0 THEN ' Attachments remained unchanged after review.' ELSE '' END END AS note
  FROM counts JOIN labels USING (event_id) JOIN acted USING (event_id) JOIN hosts USING (hostname))"""


def sides(spark: SparkSession, sf: str, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scanned texts and files, of ``events`` only where they are given."""
    texts, files = for_spark(spark, sf, "sent"), for_spark(spark, sf, "event_files")
    if events is not None:
        texts, files = (df.join(events.select("event_id"), "event_id", "left_semi") for df in (texts, files))
    return detect.scan(texts), att.scan_files(files, scope=("event_id",))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """One log entry per decided event with findings in its text or files."""
    action = pol.decision_action(F.col("decision"), F.col("mode"))
    decided = for_spark(spark, sf, "decisions").withColumns({"action": action, "trigger": F.lit("send")})
    counts = inc.event_counts(*sides(spark, sf, decided), "event_id")
    return inc.log_entries(counts.join(decided, "event_id"), "event_id")


@query(
    "incident_log",
    f"WITH {_LOG_SQL} SELECT * REPLACE (epoch_us(ts) AS ts) FROM log",
)
def incident_log(spark, sf):
    log = incidents(spark, sf)
    return log.withColumns(
        {"ts": F.unix_micros("ts"), "rule_labels": F.array_join("rule_labels", "|")}
    ).withColumnRenamed("trigger", "trigger_name")


_LOG_INPUTS = ("sent", "event_files", "decisions")


def log_path(spark: SparkSession, sf: str) -> str:
    """Where the incident log of these tables is, appended once as a batch.

    The folder is named after the tables' files, so tables that were written
    again have a log of their own.  The reports read it; no text is scanned for
    them again.
    """
    path = versioned_folder(spark, "incident-log", [for_spark(spark, sf, name) for name in _LOG_INPUTS])
    if not logs.has_batch(spark, path, "all"):
        logs.append_log(incidents(spark, sf), path, "all")
    return path


def stored_log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.read_log(spark, log_path(spark, sf))


@query("log_clear", f"WITH {_LOG_SQL} SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM log")
def log_clear(spark, sf):
    path = shared_folder(spark, "cleared-log")
    logs.append_log(stored_log(spark, sf).drop("day"), path)
    before = logs.read_log(spark, path).count()
    logs.clear_log(spark, path)
    return logs.read_log(spark, path).agg(F.lit(before).cast("bigint").alias("before"), F.count(F.lit(1)).alias("after"))


@query("log_appended_twice", f"WITH {_LOG_SQL} SELECT id, epoch_us(ts) AS ts, total_findings FROM log")
def log_appended_twice(spark, sf):
    """A batch, the same batch again, and the same entries under another name: the log has each once."""
    path = shared_folder(spark, "twice-log")
    entries = stored_log(spark, sf).drop("day")
    for batch in ("first", "first", "second"):
        logs.append_log(entries, path, batch)
    return logs.read_log(spark, path).select("id", F.unix_micros("ts").alias("ts"), "total_findings")


@query(
    "log_rollup",
    f"""WITH {_LOG_SQL}, split AS (SELECT CAST(ts AS DATE) AS day, unnest(string_split(rule_labels, '|')) AS label FROM log)
        SELECT CAST(day AS VARCHAR) AS day, label, count(*) AS entries FROM split GROUP BY ALL""",
)
def log_rollup(spark, sf):
    """Sums by day and label, kept up over three batches that share entries."""
    path = shared_folder(spark, "rollup-log")
    entries = stored_log(spark, sf).drop("day")
    part = F.crc32(F.col("id").cast("binary")) % 4
    for batch, wanted in (("a", part < 2), ("b", part > 0), ("a", part < 2), ("c", part == 3)):
        logs.append_log(entries.filter(wanted), path, batch)
    sums = logs.read_rollup(spark, path, logs.LABEL_FILES).groupBy("day", "label").agg(F.sum("entries").alias("entries"))
    return sums.select(F.col("day").cast("string").alias("day"), "label", "entries")


def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    raw = for_spark(spark, sf, "raw_log")
    return raw.withColumn("rule_labels", F.split("labels", ",")).withColumnRenamed("trigger_name", "trigger").drop("labels")


_VALID_SQL = f"""valid AS (SELECT * FROM ({for_duckdb('raw_log')}) WHERE id IS NOT NULL AND ts IS NOT NULL
  AND action IS NOT NULL AND secrets IS NOT NULL AND labels IS NOT NULL)"""


@query("log_validate", f"WITH {_VALID_SQL} SELECT id, epoch_us(ts) AS ts, hostname, action, secrets, pii, labels FROM valid")
def log_validate(spark, sf):
    valid = inc.valid_entries(raw_log(spark, sf))
    return valid.select(
        "id", F.unix_micros("ts").alias("ts"), "hostname", "action", "secrets", "pii",
        F.array_join("rule_labels", ",").alias("labels"),
    )


@query(
    "log_validate_json",
    f"""SELECT entry ->> '$.id' AS id, epoch_us(CAST(entry ->> '$.timestamp' AS TIMESTAMP)) AS ts,
          CAST(entry ->> '$.secrets' AS BIGINT) AS secrets, 'A,B' AS labels
        FROM (SELECT CAST(entry AS JSON) AS entry FROM ({for_duckdb('log_json')}) WHERE json_valid(entry))
        WHERE json_type(entry, '$.id') = 'VARCHAR' AND json_type(entry, '$.action') = 'VARCHAR'
          AND json_type(entry, '$.totalFindings') <> 'VARCHAR' AND json_type(entry, '$.ruleLabels') = 'ARRAY'
          AND json_type(entry, '$.trigger') = 'VARCHAR'""",
)
def log_validate_json(spark, sf):
    valid = logs.parse_log(for_spark(spark, sf, "log_json"), "entry")
    return valid.select("id", F.unix_micros("ts").alias("ts"), "secrets", F.array_join("rule_labels", ",").alias("labels"))


@query("log_retention", f"WITH {_VALID_SQL} SELECT id, epoch_us(ts) AS ts FROM valid ORDER BY valid.ts DESC, id LIMIT 150")
def log_retention(spark, sf):
    kept = inc.retain(inc.valid_entries(raw_log(spark, sf)))
    return kept.select("id", F.unix_micros("ts").alias("ts"))


@query("log_retention_stored", f"WITH {_VALID_SQL} SELECT id, epoch_us(ts) AS ts, labels FROM valid ORDER BY valid.ts DESC, id LIMIT 150")
def log_retention_stored(spark, sf):
    """The same on disk: days beyond the newest 150 entries are dropped unread."""
    path = shared_folder(spark, "retained-log")
    whole = raw_log(spark, sf).withColumns({"mode": F.lit("none"), "note": F.lit(None).cast("string")})
    logs.append_log(inc.valid_entries(whole), path)
    logs.retain_log(spark, path)
    kept = logs.read_log(spark, path)
    return kept.select("id", F.unix_micros("ts").alias("ts"), F.array_join("rule_labels", ",").alias("labels"))


@query(
    "log_last_7_days",
    f"WITH {_LOG_SQL} SELECT count(*) AS incidents FROM log WHERE ts >= {NOW_SQL} - INTERVAL 7 DAY",
)
def log_last_7_days(spark, sf):
    return inc.count_last_days(stored_log(spark, sf), 7, st.NOW)


@query(
    "log_top_rule",
    f"""WITH {_LOG_SQL}, split AS (
          SELECT ts, id, unnest(string_split(rule_labels, '|')) AS label, generate_subscripts(string_split(rule_labels, '|'), 1) AS pos
          FROM log),
        ranked AS (SELECT label, count(*) AS n, min({{'a': -epoch_us(ts), 'i': id, 'p': pos}}) AS first FROM split GROUP BY label)
        SELECT coalesce((SELECT label FROM ranked ORDER BY n DESC, first LIMIT 1), 'None yet') AS top_rule""",
)
def log_top_rule(spark, sf):
    return inc.top_label(logs.read_rollup(spark, log_path(spark, sf), logs.LABEL_FILES))


@query(
    "log_top_category",
    f"""WITH {_LOG_SQL} SELECT CASE WHEN coalesce(sum(secrets), 0) = 0 AND coalesce(sum(pii), 0) = 0 THEN 'None yet'
        WHEN sum(secrets) >= sum(pii) THEN 'Secrets' ELSE 'PII' END AS top_category FROM log""",
)
def log_top_category(spark, sf):
    return inc.top_category(logs.read_rollup(spark, log_path(spark, sf), logs.DAY_FILES))


@query(
    "log_recent",
    f"""WITH {_LOG_SQL} SELECT id, epoch_us(ts) AS ts, hostname, action, total_findings, rule_labels FROM log
        ORDER BY log.ts DESC, id LIMIT 6""",
)
def log_recent(spark, sf):
    newest = inc.recent(stored_log(spark, sf))
    return newest.select(
        "id", F.unix_micros("ts").alias("ts"), "hostname", "action", "total_findings",
        F.array_join("rule_labels", "|").alias("rule_labels"),
    )


@query(
    "review_counters",
    f"""WITH {_LOG_SQL}, ids AS (
          SELECT event_id FROM ({for_duckdb('sent')}) UNION SELECT event_id FROM attached)
        SELECT event_id, coalesce(total_findings, 0) AS total, coalesce(secrets, 0) AS secrets, coalesce(pii, 0) AS pii
        FROM ids LEFT JOIN counts USING (event_id)""",
)
def review_counters(spark, sf):
    return inc.review_counters("event_id", *sides(spark, sf))


_SCAN_TYPE = "CASE origin WHEN 'composer' THEN 'send' ELSE origin END"


@query(
    "last_scan_per_host",
    f"""WITH {o.resolved(for_duckdb('arriving'), 'doc_id')},
        totals AS (SELECT doc_id, count(*) AS total FROM f GROUP BY doc_id)
        SELECT hostname, {_SCAN_TYPE} AS scan_type, total, epoch_us(ts) AS ts FROM src JOIN totals USING (doc_id)
        QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY src.ts DESC, doc_id DESC) = 1""",
)
def last_scan_per_host(spark, sf):
    scanned = detect.scan(for_spark(spark, sf, "arriving")).filter(F.size("findings") > 0)
    kind = F.when(F.col("origin") == "composer", "send").otherwise(F.col("origin"))
    last = inc.last_scan(
        scanned.select("hostname", kind.alias("scan_type"), F.size("findings").alias("total"), "ts", F.col("doc_id").alias("scan_id"))
    )
    return st.bigints(last.withColumn("ts", F.unix_micros("ts")))

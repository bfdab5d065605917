"""Registered queries: the live path, run over what has arrived so far."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators import detect
from leakscan.operators import incidents as inc
from leakscan.operators import policy as pol
from leakscan.operators.policy import Policy
from leakscan.plans import logs, registry  # noqa: F401 (logs registers the SQL that a stream shares)
from leakscan.plans import oracle as o
from leakscan.plans import settings as st
from leakscan.plans.detection import FIELDS, _NOT_EXACT, allowed_sql
from leakscan.plans.inputs import INPUTS, for_duckdb, for_spark
from leakscan.plans.policies import GATE_SQL, HOSTS_SQL
from leakscan.plans.registry import query
from leakscan.sources.shared import shared_folder
from leakscan.sources.tables import table
from leakscan.streaming import live


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "documents").schema
    documents = live.read_table_stream(spark, sf, "documents", schema)
    return spark.sql(INPUTS["arriving"], documents=documents)


_SRC = (
    f"SELECT t.* FROM ({for_duckdb('arriving')}) t JOIN profiles p ON p.hostname = t.hostname WHERE {GATE_SQL} "
    "AND coalesce(file_name NOT LIKE '%.png', true)"
)
# Of an attached file only a masked preview is kept.
_COLUMNS = (
    "doc_id, rule_id, label, category, sev AS severity, CASE WHEN origin <> 'attachment' THEN s END AS start_pos, "
    "CASE WHEN origin <> 'attachment' THEN e END AS end_pos, "
    f"CASE WHEN origin = 'attachment' THEN {o.mask_snippet('m')} ELSE m END AS match, "
    "CAST(conf AS BIGINT) AS confidence, conf_label AS confidence_label"
)


def _stream_sql(more: str = "") -> str:
    keep = "conf >= " + o.STRICTNESS_SQL.format(c="profiles.strictness") + more
    joins = "JOIN src USING (doc_id) LEFT JOIN profiles ON profiles.hostname = src.hostname"
    return f"{st.profile_values()}, {o.resolved(_SRC, 'doc_id', keep=keep, joins=joins)}"


@query("stream_scan", f"WITH {_stream_sql()} SELECT {_COLUMNS} FROM f JOIN src USING (doc_id)")
def stream_scan(spark, sf):
    scanned = live.scan_stream(arriving(spark, sf), Policy(profiles=st.profiles(spark)))
    rows = scanned.select("doc_id", F.inline("findings")).select("doc_id", *FIELDS)
    return live.run_to_table(spark, st.bigints(rows), "stream-scan")


@query(
    "stream_allow",
    f"WITH {allowed_sql('seeded_allow')}, {_stream_sql(' AND ' + _NOT_EXACT)} SELECT {_COLUMNS} FROM f JOIN src USING (doc_id)",
)
def stream_allow(spark, sf):
    """Allow rules joined within the stream: in its plan, or with its micro-batches where a host has many."""
    policy = Policy(profiles=st.profiles(spark), exact_allow=st.allow_rules(spark, sf, "seeded_allow"))

    def rows(scanned: DataFrame) -> DataFrame:
        return st.bigints(scanned.select("doc_id", F.inline("findings")).select("doc_id", *FIELDS))

    return live.scan_to_table(spark, arriving(spark, sf), policy, rows, "stream-allow", as_of=st.NOW)


# Profiles as they were written over time: the days from which each holds.
_VERSIONS = {
    "2024-01-01": st.PROFILES,
    "2024-01-10": [
        ("chatgpt.com", "ChatGPT", True, "strict", True, True, "placeholder"),
        ("chat.openai.com", "ChatGPT", False, "strict", True, True, "placeholder"),
        ("claude.ai", "Claude", True, "relaxed", False, True, "full-redact"),
    ],
    "2024-01-20": [
        ("gemini.google.com", "Gemini", True, "strict", True, True, "partial-mask"),
        ("claude.ai", "Claude", True, "balanced", True, True, "full-redact"),
    ],
}
_PROFILE_COLUMNS = "hostname, label, enabled, strictness, scan_on_paste, scan_attachments, redaction_mode"
_VERSIONS_SQL = f"""written({_PROFILE_COLUMNS}, since) AS (VALUES {", ".join(
    f"('{h}', '{l}', {e}, '{s}', {p}, {a}, '{m}', TIMESTAMP '{day}')"
    for day, rows in _VERSIONS.items() for h, l, e, s, p, a, m in rows)}),
versions AS (SELECT *, lead(since) OVER (PARTITION BY hostname ORDER BY since) AS until FROM written)"""
_AS_OF_SRC = (
    f"SELECT t.*, p.strictness FROM ({for_duckdb('arriving')}) t JOIN versions p ON p.hostname = t.hostname "
    f"AND p.since <= t.ts AND coalesce(t.ts < p.until, true) WHERE {GATE_SQL} AND coalesce(file_name NOT LIKE '%.png', true)"
)
_AS_OF_SQL = f"""WITH {_VERSIONS_SQL}, {o.resolved(
    _AS_OF_SRC, 'doc_id', keep='conf >= ' + o.STRICTNESS_SQL.format(c='src.strictness'), joins='JOIN src USING (doc_id)')}
    SELECT {_COLUMNS} FROM f JOIN src USING (doc_id)"""


def in_halves(rows: DataFrame, folder: str) -> int:
    """Add rows to a folder that a stream watches, in as many files as they are read in; returns half their number.

    A file may be read by one task only, so the work of a micro-batch is dealt as that of the table is.
    """
    before = live.count_files(rows.sparkSession, folder)
    rows.write.mode("append").parquet(folder)
    return max(1, (live.count_files(rows.sparkSession, folder) - before + 1) // 2)


def in_steps(spark: SparkSession, sf: str, folder: str):
    """The arriving texts put into a folder in order of time, version by version of the profiles; yields the days."""
    texts = for_spark(spark, sf, "arriving")
    days = [*_VERSIONS, "2025-01-01"]
    for day, following in zip(days, days[1:]):
        some = texts.filter((F.col("ts") >= F.lit(day).cast("timestamp")) & (F.col("ts") < F.lit(following).cast("timestamp")))
        some.write.mode("append").parquet(f"{folder}/in")
        yield day


def profile_rows(spark: SparkSession, day: str) -> DataFrame:
    return spark.createDataFrame(_VERSIONS[day], pol.PROFILE_SCHEMA).withColumn("since", F.lit(day).cast("timestamp"))


@query("stream_reload", _AS_OF_SQL)
def stream_reload(spark, sf):
    """Profiles from a stored table that is written anew between micro-batches, and loaded when it was."""
    folder = shared_folder(spark, "stream-reload")
    schema = for_spark(spark, sf, "arriving").schema
    now = {row[0]: row for row in st.PROFILES}
    source = live.reload_when_changed(
        lambda session: sorted(session.read.parquet(f"{folder}/profiles").inputFiles()),
        lambda session: Policy(profiles=session.read.parquet(f"{folder}/profiles")),
    )
    for day in in_steps(spark, sf, folder):
        now |= {row[0]: row for row in _VERSIONS[day]}
        profiles = spark.createDataFrame(list(now.values()), pol.PROFILE_SCHEMA)
        profiles.coalesce(1).write.mode("overwrite").parquet(f"{folder}/profiles")
        texts = live.read_stream(spark, f"{folder}/in", "*.parquet", schema)
        write = live.write_numbered(f"{folder}/table")
        live.scan_with_reload(texts, source, write, f"{folder}/checkpoint").awaitTermination()
    scanned = spark.read.parquet(f"{folder}/table")
    return st.bigints(scanned.select("doc_id", F.inline("findings")).select("doc_id", *FIELDS))


@query("stream_versions", _AS_OF_SQL)
def stream_versions(spark, sf):
    """Profiles with the times from which they hold, looked up at each text's time, while versions are added."""
    folder = shared_folder(spark, "stream-versions")
    schema = for_spark(spark, sf, "arriving").schema
    for day in in_steps(spark, sf, folder):
        profile_rows(spark, day).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
        versions = pol.profile_versions(spark.read.parquet(f"{folder}/versions"))
        texts = live.read_stream(spark, f"{folder}/in", "*.parquet", schema)
        scanned = live.scan_stream(texts, Policy(), versions)
        rows = st.bigints(scanned.select("doc_id", F.inline("findings")).select("doc_id", *FIELDS))
        live.write_available(rows, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")


@query(
    "stream_pending",
    f"""WITH {o.resolved(f"SELECT * FROM ({for_duckdb('selected')}) WHERE file_name IS NOT NULL", 'doc_id')},
        latest AS (SELECT input_id, max(batch_ts) AS batch_ts FROM ({for_duckdb('selected')}) GROUP BY input_id)
        SELECT input_id, file_name, count(*) AS findings FROM f JOIN src USING (doc_id)
        JOIN latest USING (input_id, batch_ts) GROUP BY ALL""",
)
def stream_pending(spark, sf):
    """What the last selection of each input still holds; a selection of no file empties it."""
    folder = shared_folder(spark, "stream-pending")
    schema = table(spark, sf, "documents").schema
    documents = live.read_table_stream(spark, sf, "documents", schema)
    write = live.record_selections(f"{folder}/log")

    def each(batch, number):
        write(detect.scan(batch).drop("text"), number)

    run = spark.sql(INPUTS["selected"], documents=documents).writeStream.foreachBatch(each)
    run = run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    run.start().awaitTermination()
    left = live.pending_selections(spark, f"{folder}/log")
    return st.bigints(left.select("input_id", "file_name", F.size("findings").alias("findings")))


@query(
    "stream_pending_compacted",
    f"""WITH {o.resolved(f"SELECT * FROM ({for_duckdb('selected')}) WHERE file_name IS NOT NULL", 'doc_id')},
        latest AS (SELECT input_id, max(batch_ts) AS batch_ts FROM ({for_duckdb('selected')}) GROUP BY input_id)
        SELECT input_id, file_name, count(*) AS findings FROM f JOIN src USING (doc_id)
        JOIN latest USING (input_id, batch_ts) GROUP BY ALL""",
)
def stream_pending_compacted(spark, sf):
    """The same over three runs of the stream, with the change log folded into a snapshot after each of them."""
    folder = shared_folder(spark, "stream-compacted")
    given = for_spark(spark, sf, "selected")
    write = live.record_selections(f"{folder}/log")
    for part in range(3):
        half = in_halves(given.filter(F.col("doc_id") % 3 == part), f"{folder}/in")
        texts = live.read_stream(spark, f"{folder}/in", "*.parquet", given.schema, max_files=half)
        run = texts.writeStream.foreachBatch(lambda batch, number: write(detect.scan(batch).drop("text"), number))
        run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        live.compact_selections(spark, f"{folder}/log", timedelta(days=30))
    left = live.pending_selections(spark, f"{folder}/log")
    return st.bigints(left.select("input_id", "file_name", F.size("findings").alias("findings")))


@query("stream_last_scan", registry.SQL["last_scan_per_host"])
def stream_last_scan(spark, sf):
    """The newest scan of each host, kept up by a stream over several micro-batches and a restart."""
    folder = shared_folder(spark, "stream-last")
    given = for_spark(spark, sf, "arriving")
    for part in range(2):
        half = in_halves(given.filter(F.col("doc_id") % 2 == part), f"{folder}/in")
        texts = live.read_stream(spark, f"{folder}/in", "*.parquet", given.schema, max_files=half)
        scanned = detect.scan(texts).filter(F.size("findings") > 0)
        kind = F.when(F.col("origin") == "composer", "send").otherwise(F.col("origin"))
        scans = scanned.select(
            "hostname", kind.alias("scan_type"), F.size("findings").alias("total"), "ts", F.col("doc_id").alias("scan_id")
        )
        live.last_scans(scans, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    last = live.read_merged(spark, f"{folder}/table").drop("scan_id")
    return st.bigints(last.withColumn("ts", F.unix_micros("ts")))


_ACTION_SQL = "CASE origin WHEN 'paste' THEN 'pasted_flagged' WHEN 'attachment' THEN 'attachment_flagged' ELSE 'ignored_once' END"
_TRIGGER_SQL = "CASE origin WHEN 'composer' THEN 'send' ELSE origin END"


@query(
    "stream_log",
    f"""WITH {_stream_sql()}, {HOSTS_SQL},
        counts AS (
          SELECT doc_id, count(*) AS total_findings, count(*) FILTER (category = 'secret') AS secrets,
            count(*) FILTER (category = 'pii') AS pii FROM f GROUP BY doc_id),
        labels AS (
          SELECT doc_id, string_agg(label, '|' ORDER BY first_s) AS rule_labels
          FROM (SELECT doc_id, label, min(s) AS first_s FROM f GROUP BY ALL) GROUP BY doc_id)
        SELECT sha256(concat_ws(':', doc_id, epoch_us(ts), hostname, {_ACTION_SQL})) AS id, epoch_us(ts) AS ts, hostname,
          site AS site_label, {_ACTION_SQL} AS action, total_findings, secrets, pii, rule_labels,
          {_TRIGGER_SQL} AS trigger_name, 'none' AS mode,
          CASE origin WHEN 'paste' THEN 'The scanner flagged pasted text before send.'
            WHEN 'attachment' THEN 'The scanner found potential issues in an attached file.'
            ELSE 'The user chose to ignore the warning once and send original content.' END AS note
        FROM src JOIN counts USING (doc_id) JOIN labels USING (doc_id) JOIN hosts USING (hostname)""",
)
def stream_log(spark, sf):
    """Flagged texts appended to the log as they arrive."""
    scanned = live.scan_stream(arriving(spark, sf), Policy(profiles=st.profiles(spark)))
    summed = scanned.select("*", detect.summarize(F.col("findings")).alias("s")).filter(F.col("s.total") > 0)
    origin = F.col("origin")
    counted = summed.select(
        "doc_id", "hostname", "ts",
        F.col("s.total").alias("total_findings"), "s.secrets", "s.pii", "s.rule_labels",
        F.when(origin == "paste", "pasted_flagged").when(origin == "attachment", "attachment_flagged")
        .otherwise("ignored_once").alias("action"),
        F.when(origin == "composer", "send").otherwise(origin).alias("trigger"),
        F.lit("none").alias("mode"),
        F.lit(0).alias("files"),
    )
    log = live.run_to_table(spark, inc.log_entries(counted, "doc_id"), "stream-log")
    return log.withColumns(
        {"ts": F.unix_micros("ts"), "rule_labels": F.array_join("rule_labels", "|")}
    ).withColumnRenamed("trigger", "trigger_name")

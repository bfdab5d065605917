"""Registered queries: rules, detection and redaction."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions import text as tx
from leakscan.operators import detect, redact as red
from leakscan.operators import policy as pol
from leakscan.operators.policy import Policy
from leakscan.operators.rulepacks import imported_patterns, starter_pack
from leakscan.operators.rules import BUILTIN_RULES
from leakscan.plans import oracle as o
from leakscan.plans import settings as st
from leakscan.plans.inputs import AS_OF, for_duckdb, for_spark
from leakscan.plans.registry import query

DRY_RUN_FINDINGS = 6

FIELDS = (
    "rule_id", "label", "category", "severity", "start_pos", "end_pos", "match", "confidence", "confidence_label",
)


def rows(scanned: DataFrame, *keys: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return st.bigints(scanned.select(*keys, F.inline("findings")).select(*keys, *fields))


def resolved_sql(source: str, keys: str = "doc_id", **options) -> str:
    return f"WITH {o.resolved(for_duckdb(source), keys, **options)} SELECT {o.finding_columns(keys)} FROM f"


def raw_sql(source: str, columns: str, keys: str = "doc_id", rules: o.Rules | None = None) -> str:
    return f"WITH {o.scored(for_duckdb(source), keys, rules)} SELECT {keys}, {columns} FROM scored"


# --- end to end --------------------------------------------------------------


@query("scan_documents", resolved_sql("documents"))
def scan_documents(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "documents"), host_col="hostname"), "doc_id")


@query(
    "scan_conversations",
    f"""WITH {o.resolved(for_duckdb('conversations'), 'conv_id, turn, role')}
        SELECT src.conv_id, src.turn, src.role, count(f.rule_id) AS total
        FROM src LEFT JOIN f USING (conv_id, turn, role) GROUP BY ALL""",
)
def scan_conversations(spark, sf):
    scanned = detect.scan(for_spark(spark, sf, "conversations"))
    return st.bigints(scanned.select("conv_id", "turn", "role", F.size("findings").alias("total")))


@query("scan_seeded_conversations", resolved_sql("seeded_turns", "conv_id, turn, role"))
def scan_seeded_conversations(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "seeded_turns")), "conv_id", "turn", "role")


@query("scan_pages", resolved_sql("pages", "page_id, url"))
def scan_pages(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "pages")), "page_id", "url")


@query("scan_seeded", resolved_sql("seeded"))
def scan_seeded(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "seeded")), "doc_id")


_BY_HOST = "conf >= " + o.STRICTNESS_SQL.format(c="profiles.strictness")


def _guarded_sql(select: str, more: str = "") -> str:
    source = (
        f"SELECT t.* FROM ({for_duckdb('seeded')}) t JOIN profiles p ON t.hostname = p.hostname AND p.enabled"
    )
    body = o.resolved(
        source, "doc_id", keep=_BY_HOST,
        joins="JOIN src USING (doc_id) LEFT JOIN profiles ON profiles.hostname = src.hostname",
    )
    return f"WITH {st.profile_values()}, {body}{more} SELECT {select}"


@query("scan_guarded", _guarded_sql(o.finding_columns("doc_id") + " FROM f"))
def scan_guarded(spark, sf):
    """Guarded hosts only, each at its own strictness."""
    policy = Policy(profiles=st.profiles(spark))
    texts = pol.guarded(for_spark(spark, sf, "seeded"), policy)
    return rows(detect.scan(texts, policy, host_col="hostname"), "doc_id")


# --- rules -------------------------------------------------------------------

_HIT = ("rule_id", "start_pos", "end_pos", "match")
_HIT_SQL = "rule_id, s AS start_pos, e AS end_pos, m AS match"

for _source, _key in (("documents", "doc_id"), ("pages", "page_id"), ("seeded", "doc_id")):

    @query(f"rule_hits_{_source}", raw_sql(_source, _HIT_SQL, _key))
    def rule_hits(spark, sf, source=_source, key=_key):
        return rows(detect.raw_findings(for_spark(spark, sf, source)), key, fields=_HIT)


for _rule in BUILTIN_RULES:

    @query(
        f"rule_{_rule.id.replace('-', '_')}",
        raw_sql(
            "seeded", f"{_HIT_SQL}, CAST(conf AS BIGINT) AS confidence, sev AS severity",
            rules=o.Rules([_rule.id]),
        ),
    )
    def one_rule(spark, sf, rule=_rule):
        found = detect.raw_findings(for_spark(spark, sf, "seeded"), rules=[rule])
        return rows(found, "doc_id", fields=(*_HIT, "confidence", "severity"))


# --- rule selection and custom rules -----------------------------------------


@query("scan_secrets_only", resolved_sql("seeded", keep="conf >= 58 AND category = 'secret'"))
def scan_secrets_only(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "seeded"), Policy(detect_pii=False)), "doc_id")


@query("scan_pii_only", resolved_sql("seeded", keep="conf >= 58 AND category = 'pii'"))
def scan_pii_only(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "seeded"), Policy(detect_secrets=False)), "doc_id")


@query("scan_custom_rule", resolved_sql("documents", rules=o.Rules([], st.CUSTOM_SQL)))
def scan_custom_rule(spark, sf):
    """Custom rules run with both built-in categories switched off."""
    policy = Policy(detect_secrets=False, detect_pii=False, custom_patterns=st.custom(spark))
    return rows(detect.scan(for_spark(spark, sf, "documents"), policy), "doc_id")


@query("scan_with_custom_rules", resolved_sql("seeded", rules=o.Rules(None, st.CUSTOM_SQL)))
def scan_with_custom_rules(spark, sf):
    policy = Policy(custom_patterns=st.custom(spark))
    return rows(detect.scan(for_spark(spark, sf, "seeded"), policy), "doc_id")


@query("scan_starter_pack", resolved_sql("starters", rules=o.Rules(None, st.starter_sql_rules())))
def scan_starter_pack(spark, sf):
    imported = pol.normalize_custom(imported_patterns(starter_pack(spark)))
    return rows(detect.scan(for_spark(spark, sf, "starters"), Policy(custom_patterns=imported)), "doc_id")


@query(
    "custom_placeholder",
    f"""SELECT pos, '<' || coalesce(nullif(trim(regexp_replace(upper(label), '[^A-Z0-9]+', '_', 'g'), '_'), ''),
        'REDACTED') || '>' AS placeholder FROM ({for_duckdb('given_patterns')}) WHERE label IS NOT NULL""",
)
def custom_placeholder(spark, sf):
    given = for_spark(spark, sf, "given_patterns").filter(F.col("label").isNotNull())
    return given.select("pos", tx.placeholder_from_label(F.col("label")).alias("placeholder"))


_FLAGS_SQL = (
    "array_to_string(list_filter(string_split(regexp_replace(coalesce(flags, 'g'), '[^dgimsuy]', '', 'g'), ''), "
    "lambda x, i: list_position(string_split(regexp_replace(coalesce(flags, 'g'), '[^dgimsuy]', '', 'g'), ''), x) "
    "= i), '')"
)


@query("custom_flags", f"SELECT pos, {_FLAGS_SQL} AS flags FROM ({for_duckdb('given_patterns')})")
def custom_flags(spark, sf):
    given = for_spark(spark, sf, "given_patterns")
    return given.select("pos", tx.sanitize_flags(F.coalesce("flags", F.lit("g"))).alias("flags"))


# --- what a finding carries --------------------------------------------------


@query(
    "strictness_threshold",
    f"""WITH {st.profile_values()} SELECT doc_id, CAST({o.STRICTNESS_SQL.format(c='strictness')} AS BIGINT) AS threshold
        FROM ({for_duckdb('mixed_hosts')}) t LEFT JOIN profiles USING (hostname)""",
)
def strictness_threshold(spark, sf):
    hosts = Policy(profiles=st.profiles(spark)).host_table(spark).select("hostname", "threshold")
    joined = for_spark(spark, sf, "mixed_hosts").join(F.broadcast(hosts), "hostname", "left")
    return joined.select(
        "doc_id", F.coalesce("threshold", F.lit(detect.THRESHOLDS["balanced"])).cast("bigint").alias("threshold")
    )


@query(
    "finding_spans",
    f"""WITH {o.scored(for_duckdb('seeded'), 'doc_id')} SELECT doc_id, rule_id, s AS start_pos, e AS end_pos,
        substr(text, s + 1, e - s) = m AS exact FROM scored JOIN src USING (doc_id)""",
)
def finding_spans(spark, sf):
    found = detect.raw_findings(for_spark(spark, sf, "seeded"))
    at = found.select("doc_id", "text", F.inline("findings"))
    span = F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    return st.bigints(at.select("doc_id", "rule_id", "start_pos", "end_pos", (span == F.col("match")).alias("exact")))


_PHONE = next(rule for rule in BUILTIN_RULES if rule.id == "phone")


def phone_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the phone pattern matches, valid or not."""
    unchecked = replace(_PHONE, id="phone-candidate")
    found = detect.raw_findings(for_spark(spark, sf, "documents"), rules=[unchecked])
    return found.select("doc_id", F.inline("findings")).select("doc_id", "start_pos", "match")


@query("phone_validated", raw_sql("documents", "s AS start_pos, m AS match", rules=o.Rules(["phone"])))
def phone_validated(spark, sf):
    return st.bigints(phone_candidates(spark, sf).filter(detect.looks_like_phone(F.col("match"))))


@query(
    "phone_rejected_reasons",
    f"""WITH {o.scored(for_duckdb('documents'), 'doc_id', o.Rules(['phone']))} SELECT doc_id, s AS start_pos,
        CASE WHEN {o.IPV4} THEN 'ipv4' WHEN length(regexp_replace(m, '\\D', '', 'g')) NOT BETWEEN 10 AND 15
        THEN 'digits' ELSE 'kept' END AS outcome FROM hit""",
)
def phone_rejected_reasons(spark, sf):
    match = F.col("match")
    outcome = (
        F.when(detect.looks_like_ipv4(match), "ipv4")
        .when(~detect.looks_like_phone(match), "digits")
        .otherwise("kept")
    )
    return st.bigints(phone_candidates(spark, sf).select("doc_id", "start_pos", outcome.alias("outcome")))


@query("finding_context", raw_sql("seeded", "rule_id, s AS start_pos, context"))
def finding_context(spark, sf):
    found = detect.explode_findings(detect.raw_findings(for_spark(spark, sf, "seeded")), "doc_id")
    return st.bigints(found.select("doc_id", "rule_id", "start_pos", "context"))


def _raw_field(name: str, field, sql: str) -> None:
    @query(name, raw_sql("seeded", f"rule_id, s AS start_pos, {sql}"))
    def one_field(spark, sf):
        found = detect.raw_findings(for_spark(spark, sf, "seeded")).select("doc_id", F.inline("findings"))
        return st.bigints(found.select("doc_id", "rule_id", "start_pos", *field()))


_raw_field("finding_confidence", lambda: ["confidence"], "CAST(conf AS BIGINT) AS confidence")
_raw_field("confidence_label", lambda: ["confidence_label"], "conf_label AS confidence_label")
_raw_field("finding_severity", lambda: ["severity"], "sev AS severity")
_raw_field("finding_why", lambda: [F.array_join("why", "|").alias("why")], "why")
_raw_field(
    "finding_fingerprint", lambda: ["snippet", "allow_fingerprint"], "snippet, fingerprint AS allow_fingerprint"
)
_raw_field(
    "mask_snippet",
    lambda: [tx.mask_snippet(F.col("match")).alias("preview")],
    o.mask_snippet("m") + " AS preview",
)


@query(
    "finding_ids",
    f"""WITH {o.resolved(for_duckdb('seeded'), 'doc_id')} SELECT doc_id, rule_id,
        sha256(doc_id || ':' || rule_id || ':' || s || ':' || e) AS finding_id, source, placeholder, explanation,
        'composer' AS origin FROM f""",
)
def finding_ids(spark, sf):
    found = detect.explode_findings(detect.scan(for_spark(spark, sf, "seeded")), "doc_id")
    return found.select("doc_id", "rule_id", "finding_id", "source", "placeholder", "explanation", "origin")


# --- allow rules -------------------------------------------------------------


def allowed_sql(source: str) -> str:
    return f"""allowed AS (
  SELECT hostname, rule_id, match_fingerprint FROM ({for_duckdb(source)}) a
  WHERE expires_at IS NULL OR CAST(expires_at AS TIMESTAMP) > TIMESTAMP '{AS_OF}')"""


_NOT_EXACT = """NOT EXISTS (SELECT 1 FROM allowed a WHERE a.hostname = src.hostname
  AND a.rule_id = scored.rule_id AND a.match_fingerprint = scored.fingerprint)"""
_NOT_WORKSPACE = " AND ".join(
    f"NOT regexp_matches({c}, {o.q(p)})" for p in st.WORKSPACE_SQL for c in ("m", "context")
)


def allow_policy(spark, sf, source: str) -> Policy:
    return Policy(exact_allow=st.allow_rules(spark, sf, source), workspace_allow=st.workspace(spark))


@query(
    "allow_exact_suppressed",
    f"""WITH {allowed_sql('seeded_allow')}, {o.resolved(for_duckdb('seeded'), 'doc_id', joins='JOIN src USING (doc_id)',
        keep='conf >= 58 AND ' + _NOT_EXACT)} SELECT {o.finding_columns('doc_id')} FROM f""",
)
def allow_exact_suppressed(spark, sf):
    policy = Policy(exact_allow=st.allow_rules(spark, sf, "seeded_allow"))
    return rows(detect.scan(for_spark(spark, sf, "seeded"), policy, host_col="hostname", as_of=st.NOW), "doc_id")


@query("allow_workspace_suppressed", resolved_sql("seeded", keep="conf >= 58 AND " + _NOT_WORKSPACE))
def allow_workspace_suppressed(spark, sf):
    policy = Policy(workspace_allow=st.workspace(spark))
    return rows(detect.scan(for_spark(spark, sf, "seeded"), policy), "doc_id")


@query(
    "allow_both_suppressed",
    f"""WITH {allowed_sql('overlap_allow')}, {o.resolved(for_duckdb('overlaps'), 'doc_id', joins='JOIN src USING (doc_id)',
        keep='conf >= 58 AND ' + _NOT_WORKSPACE + ' AND ' + _NOT_EXACT)}
        SELECT {o.finding_columns('doc_id')} FROM f""",
)
def allow_both_suppressed(spark, sf):
    """Allowing the stronger of two overlapping findings brings out the weaker one."""
    texts = for_spark(spark, sf, "overlaps")
    policy = allow_policy(spark, sf, "overlap_allow")
    return rows(detect.scan(texts, policy, host_col="hostname", as_of=st.NOW), "doc_id")


@query(
    "allow_at_scan_time",
    f"""WITH allowed AS (
          SELECT hostname, rule_id, match_fingerprint, CAST(created_at AS TIMESTAMP) AS since,
            CAST(expires_at AS TIMESTAMP) AS until FROM ({for_duckdb('timed_allow')}) a),
        {o.resolved(for_duckdb('arriving'), 'doc_id', joins='JOIN src USING (doc_id)', keep='conf >= 58 AND ' + _NOT_EXACT[:-1]
         + " AND a.since <= src.ts AND coalesce(a.until > src.ts, true))")}
        SELECT {o.finding_columns('doc_id')}, epoch_us(ts) AS ts FROM f JOIN src USING (doc_id)""",
)
def allow_at_scan_time(spark, sf):
    """Every text under the rules that were in force when it was sent."""
    policy = Policy(exact_allow=st.allow_rules(spark, sf, "timed_allow"))
    scanned = detect.scan(for_spark(spark, sf, "arriving"), policy, host_col="hostname", at="ts")
    return rows(scanned.withColumn("ts", F.unix_micros("ts")), "doc_id", "ts")


@query("scan_ignore_allow", resolved_sql("seeded"))
def scan_ignore_allow(spark, sf):
    policy = allow_policy(spark, sf, "seeded_allow")
    texts = for_spark(spark, sf, "seeded")
    return rows(detect.scan(texts, policy, host_col="hostname", as_of=st.NOW, ignore_allow=True), "doc_id")


# --- strictness, overlaps, summary -------------------------------------------

for _level, _least in detect.THRESHOLDS.items():

    @query(f"scan_{_level}", resolved_sql("overlaps", keep=f"conf >= {_least}"))
    def scan_at(spark, sf, level=_level):
        return rows(detect.scan(for_spark(spark, sf, "overlaps"), strictness=level), "doc_id")


@query("overlap_resolved", resolved_sql("pages", "page_id"))
def overlap_resolved(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "pages")), "page_id")


@query("overlap_seeded", resolved_sql("overlaps"))
def overlap_seeded(spark, sf):
    return rows(detect.scan(for_spark(spark, sf, "overlaps")), "doc_id")


SUMMARY_SQL = """summary AS (
  SELECT doc_id, count(*) AS total, count(*) FILTER (category = 'secret') AS secrets,
    count(*) FILTER (category = 'pii') AS pii, count(*) FILTER (sev = 'critical') AS critical,
    count(*) FILTER (conf_label = 'high') AS high_confidence FROM f GROUP BY doc_id),
labelled AS (
  SELECT doc_id, string_agg(label, '|' ORDER BY first_s) AS rule_labels
  FROM (SELECT doc_id, label, min(s) AS first_s FROM f GROUP BY doc_id, label) GROUP BY doc_id)"""


@query(
    "scan_summary",
    f"""WITH {o.resolved(for_duckdb('seeded'), 'doc_id')}, {SUMMARY_SQL}
        SELECT src.doc_id, coalesce(total, 0) AS total, coalesce(secrets, 0) AS secrets, coalesce(pii, 0) AS pii,
          coalesce(critical, 0) AS critical, coalesce(high_confidence, 0) AS high_confidence,
          coalesce(rule_labels, '') AS rule_labels,
          CASE WHEN total IS NULL THEN NULL WHEN secrets >= pii THEN 'secret' ELSE 'pii' END AS top_category
        FROM src LEFT JOIN summary USING (doc_id) LEFT JOIN labelled USING (doc_id)""",
)
def scan_summary(spark, sf):
    scanned = detect.scan(for_spark(spark, sf, "seeded"))
    summed = scanned.select("doc_id", detect.summarize(F.col("findings")).alias("s")).select("doc_id", "s.*")
    return st.bigints(summed.withColumn("rule_labels", F.array_join("rule_labels", "|")))


# --- redaction ---------------------------------------------------------------

_STAND_IN = {"placeholder": "placeholder", "partial-mask": o.partial_mask("m"), "full-redact": "'[REDACTED]'"}


def _redacted_sql(source: str, stand_in: str, column: str = "redacted", escape: bool = False) -> str:
    return (
        f"WITH {o.resolved(for_duckdb(source), 'doc_id')}, {o.rewritten('doc_id', stand_in, escape)} "
        f"SELECT doc_id, new_text AS {column} FROM rewritten"
    )


for _mode, _name in (
    ("placeholder", "redact_placeholder"), ("partial-mask", "redact_partial_mask"), ("full-redact", "redact_full"),
):

    @query(_name, _redacted_sql("seeded", _STAND_IN[_mode]))
    def redact_as(spark, sf, mode=_mode):
        scanned = detect.scan(for_spark(spark, sf, "seeded"))
        return red.redact(scanned, mode).select("doc_id", "redacted")


@query("redact_corpus", _redacted_sql("documents", _STAND_IN["placeholder"]))
def redact_corpus(spark, sf):
    return red.redact(detect.scan(for_spark(spark, sf, "documents")), "placeholder").select("doc_id", "redacted")


_MODE_CASE = (
    "CASE redaction_mode WHEN 'placeholder' THEN placeholder "
    f"WHEN 'partial-mask' THEN {o.partial_mask('m')} ELSE '[REDACTED]' END"
)


@query(
    "redact_by_profile",
    _guarded_sql(
        "doc_id, redaction_mode AS mode, new_text AS redacted FROM rewritten JOIN profiles USING (hostname)",
        ", moded AS (SELECT f.*, redaction_mode FROM f JOIN src USING (doc_id) JOIN profiles USING (hostname)),"
        + o.rewritten("doc_id", _MODE_CASE).replace(" FROM f)", " FROM moded f)"),
    ),
)
def redact_by_profile(spark, sf):
    policy = Policy(profiles=st.profiles(spark))
    texts = pol.with_mode(pol.guarded(for_spark(spark, sf, "seeded"), policy), policy)
    scanned = detect.scan(texts, policy, host_col="hostname")
    return red.redact(scanned, F.col("mode")).select("doc_id", "mode", "redacted")


@query(
    "report_highlight",
    _redacted_sql(
        "overlaps",
        f"'<mark class=\"found found--' || category || '\">' || {o.escape_html('m')} || '</mark>'",
        "markup", True,
    ),
)
def report_highlight(spark, sf):
    scanned = detect.scan(for_spark(spark, sf, "overlaps"))
    return scanned.select("doc_id", red.highlighted(F.col("text"), F.col("findings")).alias("markup"))


@query(
    "report_preview",
    _redacted_sql(
        "overlaps",
        f"'<mark class=\"found found--replacement\">' || {o.escape_html('placeholder')} || '</mark>'",
        "markup", True,
    ),
)
def report_preview(spark, sf):
    scanned = detect.scan(for_spark(spark, sf, "overlaps"))
    markup = red.replacement_preview(F.col("text"), F.col("findings"), F.lit("placeholder"))
    return scanned.select("doc_id", markup.alias("markup"))


@query(
    "dry_run",
    f"""WITH {st.profile_values()}, {o.resolved(
        f"SELECT doc_id, hostname, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM ({for_duckdb('overlaps')})",
        'doc_id', keep=_BY_HOST,
        joins='JOIN src USING (doc_id) LEFT JOIN profiles ON profiles.hostname = src.hostname')},
        {o.rewritten('doc_id', "'<mark class=\"found found--replacement\">' || "
                     + o.escape_html(o.partial_mask('m')) + " || '</mark>'", True)}
        SELECT doc_id, new_text AS preview, coalesce(n, 0) AS total FROM rewritten
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) USING (doc_id)""",
)
def dry_run(spark, sf):
    """Trimmed text, allow rules off, the host's strictness, a marked preview."""
    policy = allow_policy(spark, sf, "overlap_allow")
    policy.profiles = st.profiles(spark)
    texts = for_spark(spark, sf, "overlaps").withColumn("text", tx.ws_trim(F.col("text")))
    scanned = detect.scan(texts, policy, host_col="hostname", origin="test-lab", ignore_allow=True)
    markup = red.replacement_preview(F.col("text"), F.col("findings"), F.lit("partial-mask"))
    return st.bigints(scanned.select("doc_id", markup.alias("preview"), F.size("findings").alias("total")))


@query(
    "dry_run_findings",
    f"""WITH {o.resolved(for_duckdb('overlaps'), 'doc_id')} SELECT doc_id, label, category, CAST(conf AS BIGINT) AS confidence,
        explanation, replace(why, '|', ' ') AS why FROM f
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s) <= 6""",
)
def dry_run_findings(spark, sf):
    """The findings a dry run lists: the first six of each text."""
    scanned = detect.scan(for_spark(spark, sf, "overlaps"), origin="test-lab", ignore_allow=True)
    shown = scanned.select("doc_id", F.inline(F.slice("findings", 1, DRY_RUN_FINDINGS)))
    return st.bigints(
        shown.select("doc_id", "label", "category", "confidence", "explanation", F.array_join("why", " ").alias("why"))
    )

"""Registered queries: hosts, profiles, allow rules and decisions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from leakscan.operators import detect
from leakscan.operators import policy as pol
from leakscan.operators import rulepacks as packs
from leakscan.operators.patterns import refused
from leakscan.operators.policy import Policy
from leakscan.operators.rules import BUILTIN_RULES
from leakscan.plans import oracle as o
from leakscan.plans import settings as st
from leakscan.plans.detection import _FLAGS_SQL
from leakscan.plans.inputs import AS_OF, for_duckdb, for_spark
from leakscan.plans.registry import query
from leakscan.sources import settings

NOW_SQL = f"TIMESTAMP '{AS_OF}'"
HOSTS_SQL = (
    "hosts(hostname, site) AS (VALUES ('chatgpt.com', 'ChatGPT'), ('chat.openai.com', 'ChatGPT'), "
    "('claude.ai', 'Claude'), ('gemini.google.com', 'Gemini'))"
)


def micros(name: str):
    return F.unix_micros(name).alias(name)


# --- hosts and profiles ------------------------------------------------------


@query(
    "host_label",
    f"""WITH {HOSTS_SQL} SELECT doc_id, coalesce(site, t.hostname) AS site_label
        FROM ({for_duckdb('mixed_hosts')}) t LEFT JOIN hosts USING (hostname)""",
)
def host_label(spark, sf):
    return for_spark(spark, sf, "mixed_hosts").select("doc_id", pol.site_label(F.col("hostname")).alias("site_label"))


@query(
    "guarded_docs",
    f"""WITH {st.profile_values()} SELECT doc_id, hostname FROM ({for_duckdb('mixed_hosts')}) t
        WHERE hostname IN (SELECT hostname FROM profiles WHERE enabled)""",
)
def guarded_docs(spark, sf):
    policy = Policy(profiles=st.profiles(spark))
    return pol.guarded(for_spark(spark, sf, "mixed_hosts"), policy).select("doc_id", "hostname")


GATE_SQL = (
    "p.enabled AND CASE origin WHEN 'paste' THEN p.scan_on_paste WHEN 'attachment' THEN p.scan_attachments "
    "ELSE true END"
)


@query(
    "gated_by_origin",
    f"""WITH {st.profile_values()} SELECT doc_id, t.hostname, origin FROM ({for_duckdb('mixed_hosts')}) t
        JOIN profiles p ON p.hostname = t.hostname WHERE {GATE_SQL}""",
)
def gated_by_origin(spark, sf):
    policy = Policy(profiles=st.profiles(spark))
    gated = pol.guarded(for_spark(spark, sf, "mixed_hosts"), policy, origin_col="origin")
    return gated.select("doc_id", "hostname", "origin")


@query(
    "profiles_default",
    f"""WITH {HOSTS_SQL} SELECT doc_id, site AS label, site IS NOT NULL AS guarded,
        CASE WHEN site IS NOT NULL THEN 'balanced' END AS strictness,
        CASE WHEN site IS NOT NULL THEN 'placeholder' END AS redaction_mode
        FROM ({for_duckdb('mixed_hosts')}) t LEFT JOIN hosts USING (hostname)""",
)
def profiles_default(spark, sf):
    joined = for_spark(spark, sf, "mixed_hosts").join(F.broadcast(pol.default_profiles(spark)), "hostname", "left")
    guarded = F.coalesce("enabled", F.lit(False)).alias("guarded")
    return joined.select("doc_id", "label", guarded, "strictness", "redaction_mode")


_PROFILES_SQL = f"""{HOSTS_SQL},
given AS ({for_duckdb('given_profiles')}),
legacy AS ({for_duckdb('legacy_hosts')}),
profiles AS (
  SELECT u.user_key, h.hostname, coalesce(g.label, site) AS label, coalesce(enabled, true) AS enabled,
    CASE WHEN strictness IN ('relaxed', 'balanced', 'strict') THEN strictness ELSE 'balanced' END AS strictness,
    coalesce(scan_on_paste, true) AS scan_on_paste, coalesce(scan_attachments, true) AS scan_attachments,
    CASE WHEN redaction_mode IN ('placeholder', 'partial-mask', 'full-redact') THEN redaction_mode
      ELSE 'placeholder' END AS redaction_mode
  FROM (SELECT DISTINCT user_key FROM given) u CROSS JOIN hosts h
  LEFT JOIN given g ON g.user_key = u.user_key AND g.hostname = h.hostname)"""


@query("profiles_normalized", f"WITH {_PROFILES_SQL} SELECT * FROM profiles")
def profiles_normalized(spark, sf):
    return pol.normalize_profiles(for_spark(spark, sf, "given_profiles"), ("user_key",))


@query(
    "profiles_legacy",
    f"""WITH {_PROFILES_SQL} SELECT profiles.* REPLACE (CASE WHEN hosts IS NULL THEN enabled
        ELSE list_contains(string_split(hosts, ','), hostname) END AS enabled)
        FROM profiles JOIN legacy USING (user_key)""",
)
def profiles_legacy(spark, sf):
    legacy = for_spark(spark, sf, "legacy_hosts").select("user_key", F.split("hosts", ",").alias("allowed_hostnames"))
    return pol.normalize_profiles(for_spark(spark, sf, "given_profiles"), ("user_key",), legacy)


# --- normalising -------------------------------------------------------------


def _trim(name: str) -> str:
    return rf"regexp_replace({name}, '^\s+|\s+$', '', 'g')"


def _id(*parts: str) -> str:
    joined = " || chr(10) || ".join(parts)
    return f"coalesce(nullif(id, ''), sha256({joined}))"


_CUSTOM_SQL = f"""custom AS (
  SELECT user_key, {_id('user_key', 'label', 'pattern', 'category')} AS id, {_trim('label')} AS label, pattern,
    {_FLAGS_SQL} AS flags, category, coalesce(enabled, true) AS enabled, {_trim('explanation')} AS explanation,
    {_trim('placeholder')} AS placeholder
  FROM ({for_duckdb('given_patterns')}) WHERE label IS NOT NULL AND pattern IS NOT NULL AND category IN ('secret', 'pii'))"""


def normalized_custom(spark, sf):
    return pol.normalize_custom(for_spark(spark, sf, "given_patterns"), ("user_key",)).drop("pos")


@query("custom_normalized", f"WITH {_CUSTOM_SQL} SELECT * FROM custom")
def custom_normalized(spark, sf):
    return normalized_custom(spark, sf)


@query(
    "custom_rejected",
    f"""SELECT pos, pattern, CASE pos % 10 WHEN 0 THEN 'nothing to repeat' WHEN 1 THEN 'invalid group'
          WHEN 2 THEN 'invalid group' WHEN 3 THEN 'incomplete quantifier'
          WHEN 5 THEN 'refers to a group that may not have taken part'
          WHEN 7 THEN 'repeats without bound a group that branches or varies in length'
          ELSE 'unterminated group' END AS reason
        FROM ({for_duckdb('odd_patterns')}) WHERE pos % 10 IN (0, 1, 2, 5, 7, 8) OR pos % 20 = 3""",
)
def custom_rejected(spark, sf):
    return st.bigints(refused(for_spark(spark, sf, "odd_patterns")).select("pos", "pattern", "reason"))


_ALLOW_SQL = f"""allow AS (
  SELECT user_key, {_id('user_key', 'hostname', 'rule_id', 'match_fingerprint', 'pos')} AS id,
    coalesce({_trim('label')}, 'Allowlisted finding') AS label, hostname, rule_id, match_fingerprint,
    coalesce(TRY_CAST(created_at AS TIMESTAMP), {NOW_SQL}) AS created_at,
    TRY_CAST(expires_at AS TIMESTAMP) AS expires_at, pos
  FROM ({for_duckdb('given_allow')}) WHERE hostname IN (SELECT hostname FROM hosts) AND rule_id IS NOT NULL),
live AS (SELECT * FROM allow WHERE expires_at IS NULL OR expires_at > {NOW_SQL}),
purged AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY pos, id) <= 200)"""
_ALLOW_COLUMNS = (
    "user_key, pos, id, label, hostname, rule_id, match_fingerprint, epoch_us(created_at) AS created_at, "
    "epoch_us(expires_at) AS expires_at"
)


def normalized_allow(spark, sf):
    return pol.normalize_exact_allow(for_spark(spark, sf, "given_allow"), st.NOW, ("user_key",))


def live_allow(spark, sf, keep=None):
    return pol.purge_expired(normalized_allow(spark, sf), st.NOW, ("user_key",), keep)


def allow_columns(df):
    return df.select(
        "user_key", F.col("pos").cast("bigint").alias("pos"), "id", "label", "hostname", "rule_id", "match_fingerprint",
        micros("created_at"), micros("expires_at"),
    )


@query("allow_normalized", f"WITH {HOSTS_SQL}, {_ALLOW_SQL} SELECT {_ALLOW_COLUMNS} FROM allow")
def allow_normalized(spark, sf):
    return allow_columns(normalized_allow(spark, sf))


@query("allow_purged", f"WITH {HOSTS_SQL}, {_ALLOW_SQL} SELECT {_ALLOW_COLUMNS} FROM purged")
def allow_purged(spark, sf):
    """The rules a user keeps: the newest so many."""
    return allow_columns(live_allow(spark, sf, pol.MAX_EXACT_ALLOW))


_WORKSPACE_SQL = f"""workspace AS (
  SELECT user_key, {_id('user_key', 'label', 'pattern')} AS id, {_trim('label')} AS label, pattern,
    {_FLAGS_SQL} AS flags, coalesce(enabled, true) AS enabled, pos
  FROM ({for_duckdb('given_patterns')}) WHERE label IS NOT NULL AND pattern IS NOT NULL)"""


def normalized_workspace(spark, sf, keep=None):
    return pol.normalize_workspace(for_spark(spark, sf, "given_patterns"), ("user_key",), keep)


@query(
    "workspace_normalized",
    f"""WITH {_WORKSPACE_SQL} SELECT * FROM workspace
        QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY pos) <= 100""",
)
def workspace_normalized(spark, sf):
    """The patterns a user keeps: the first so many."""
    return normalized_workspace(spark, sf, pol.MAX_WORKSPACE_ALLOW)


@query(
    "packs_normalized",
    f"""SELECT user_key, {_id('user_key', 'name', 'description', 'pos')} AS id, {_trim('name')} AS name,
          {_trim('description')} AS description,
          epoch_us(coalesce(TRY_CAST(imported_at AS TIMESTAMP), {NOW_SQL})) AS imported_at, pattern_count, pos
        FROM ({for_duckdb('given_packs')})
        WHERE name IS NOT NULL AND description IS NOT NULL AND pattern_count IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY pos) <= 24""",
)
def packs_normalized(spark, sf):
    kept = pol.normalize_packs(for_spark(spark, sf, "given_packs"), st.NOW, ("user_key",), pol.MAX_PACKS)
    return kept.withColumn("imported_at", F.unix_micros("imported_at"))


# --- rule packs --------------------------------------------------------------

_PACK_SQL = f"""packs AS (
  SELECT pack_key, CAST(pack AS JSON) AS pack FROM ({for_duckdb('pack_json')}) WHERE json_valid(pack)),
patterns AS (
  SELECT pack_key, CASE WHEN json_type(p, '$.label') = 'VARCHAR' THEN p ->> '$.label' END AS label,
    CASE WHEN json_type(p, '$.pattern') = 'VARCHAR' THEN p ->> '$.pattern' END AS pattern, p ->> '$.flags' AS flags,
    p ->> '$.category' AS category, p ->> '$.explanation' AS explanation, p ->> '$.placeholder' AS placeholder
  FROM (SELECT pack_key, unnest(CAST(pack -> '$.patterns' AS JSON[])) AS p FROM packs)),
usable AS (SELECT * FROM patterns WHERE label IS NOT NULL AND pattern IS NOT NULL AND category IS NOT NULL)"""


@query(
    "rulepack_import",
    f"""WITH {_PACK_SQL} SELECT pack_key, {_trim('label')} AS label, pattern, {_FLAGS_SQL} AS flags, category,
          true AS enabled, nullif({_trim('explanation')}, '') AS explanation,
          nullif({_trim('placeholder')}, '') AS placeholder
        FROM usable WHERE category IN ('secret', 'pii')""",
)
def rulepack_import(spark, sf):
    parsed = packs.parse_packs(for_spark(spark, sf, "pack_json"), "pack")
    return pol.normalize_custom(packs.imported_patterns(parsed, ("pack_key",)), ("pack_key",)).drop("id")


@query(
    "rulepack_meta",
    f"""WITH {_PACK_SQL} SELECT pack_key, pack ->> '$.name' AS name,
          coalesce(pack ->> '$.description', 'Imported rule pack.') AS description,
          epoch_us({NOW_SQL}) AS imported_at, count(usable.pack_key) AS pattern_count
        FROM packs LEFT JOIN usable USING (pack_key) GROUP BY ALL""",
)
def rulepack_meta(spark, sf):
    parsed = packs.parse_packs(for_spark(spark, sf, "pack_json"), "pack")
    meta = packs.imported_meta(parsed, st.NOW, ("pack_key",))
    return st.bigints(meta.withColumn("imported_at", F.unix_micros("imported_at")))


def _json_fields(*names: str) -> str:
    parts = [f"CASE WHEN {n} IS NULL THEN NULL ELSE '\"{n}\":' || CAST(to_json({n}) AS VARCHAR) END" for n in names]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_EXPORTED = _json_fields("label", "pattern", "flags", "category", "explanation", "placeholder")


@query("rulepack_export_lines", f"WITH {_CUSTOM_SQL} SELECT {_EXPORTED} AS pattern_json FROM custom")
def rulepack_export_lines(spark, sf):
    return packs.export_patterns(normalized_custom(spark, sf))


@query(
    "rulepack_export",
    f"""WITH {_CUSTOM_SQL.replace('SELECT user_key, ', 'SELECT owner, ').replace("sha256(user_key ||", "sha256(owner ||")}
        SELECT owner, '{{"name":"Rule export","description":"Exported custom rules.","patterns":['
          || string_agg({_EXPORTED}, ',' ORDER BY id, label, pattern, flags, category,
          explanation NULLS FIRST, placeholder NULLS FIRST) || ']}}' AS pack_json FROM custom GROUP BY owner""",
)
def rulepack_export(spark, sf):
    """One pack per owner; an owner has a fixed number of patterns at any scale."""
    custom = pol.normalize_custom(for_spark(spark, sf, "given_patterns"), ("owner",))
    return packs.export_packs(custom, ("owner",))


# --- stored settings ---------------------------------------------------------


def stored(spark, sf):
    raw = settings.parse_settings(for_spark(spark, sf, "settings_json"), "settings")
    return settings.settings_tables(raw, ("user_key",), st.NOW)


_STORED_SQL = f"s AS (SELECT user_key, CAST(settings AS JSON) AS j FROM ({for_duckdb('settings_json')}))"


@query(
    "settings_toggles",
    f"""WITH {_STORED_SQL} SELECT user_key, coalesce(j ->> '$.enabled' <> 'false', true) AS enabled,
          true AS detect_secrets, coalesce(j ->> '$.detectPII' <> 'false', true) AS detect_pii,
          true AS show_inline_warnings, true AS scan_on_paste, true AS scan_attachments,
          CASE WHEN j ->> '$.defaultRedactionMode' IN ('placeholder', 'partial-mask', 'full-redact')
            THEN j ->> '$.defaultRedactionMode' ELSE 'placeholder' END AS default_mode FROM s""",
)
def settings_toggles(spark, sf):
    return stored(spark, sf).toggles


@query(
    "settings_profiles",
    f"""WITH {_STORED_SQL}, {HOSTS_SQL}, p AS (
          SELECT user_key, hostname, site, json_extract(j, '$.siteProfiles."' || hostname || '"') AS p
          FROM s CROSS JOIN hosts)
        SELECT user_key, hostname, site AS label, coalesce(p ->> '$.enabled' <> 'false', true) AS enabled,
          coalesce(p ->> '$.strictness', 'balanced') AS strictness, true AS scan_on_paste, true AS scan_attachments,
          'placeholder' AS redaction_mode FROM p""",
)
def settings_profiles(spark, sf):
    return stored(spark, sf).profiles


@query(
    "settings_rules",
    f"""WITH {_STORED_SQL}
        SELECT user_key, 'custom' AS kind, j ->> '$.customPatterns[0].id' AS id,
          trim(j ->> '$.customPatterns[0].label') AS label, j ->> '$.customPatterns[0].pattern' AS value FROM s
        WHERE json_type(j, '$.customPatterns[0].label') = 'VARCHAR'
        UNION ALL SELECT user_key, 'exact', j ->> '$.exactAllowRules[0].id', 'Allowlisted finding',
          j ->> '$.exactAllowRules[0].matchFingerprint' FROM s
        UNION ALL SELECT user_key, 'exact', j ->> '$.exactAllowRules[2].id', 'Allowlisted finding',
          j ->> '$.exactAllowRules[2].matchFingerprint' FROM s
        UNION ALL SELECT user_key, 'workspace', sha256(concat_ws(chr(10), user_key, ' w ', j ->> '$.workspaceAllowlist[0].pattern')),
          'w', j ->> '$.workspaceAllowlist[0].pattern' FROM s""",
)
def settings_rules(spark, sf):
    tables = stored(spark, sf)
    parts = (("custom", tables.custom_patterns, "pattern"), ("exact", tables.exact_allow, "match_fingerprint"),
             ("workspace", tables.workspace_allow, "pattern"))
    custom, exact, workspace = (
        df.select("user_key", F.lit(kind).alias("kind"), "id", "label", F.col(value).alias("value"))
        for kind, df, value in parts
    )
    return custom.unionByName(exact).unionByName(workspace)


_USER_PROFILE = f"""users AS (
  SELECT user_key, hostname, coalesce(j ->> '$.detectPII' <> 'false', true) AS pii,
    coalesce(j ->> '$.enabled' <> 'false', true)
      AND coalesce(json_extract(j, '$.siteProfiles."' || hostname || '"') ->> '$.enabled' <> 'false', true) AS enabled,
    coalesce(json_extract(j, '$.siteProfiles."' || hostname || '"') ->> '$.strictness', 'balanced') AS strictness,
    j ->> '$.exactAllowRules[2].matchFingerprint' AS allowed,
    json_type(j, '$.customPatterns[0].label') = 'VARCHAR' AS own FROM s CROSS JOIN hosts)"""
_BY_USER = (
    f"SELECT t.* FROM ({for_duckdb('by_user')}) t JOIN users USING (user_key, hostname) WHERE users.enabled"
)
_BY_USER_KEEP = (
    "conf >= " + o.STRICTNESS_SQL.format(c="users.strictness") + " AND (users.pii OR category = 'secret' OR source = 'custom') "
    "AND (rule_id <> 'c' OR users.own) "
    "AND NOT (src.hostname = 'claude.ai' AND scored.fingerprint = users.allowed AND scored.rule_id = 'email')"
)


def _by_user_sql(rules: o.Rules) -> str:
    joins = "JOIN src USING (doc_id) JOIN users ON users.user_key = src.user_key AND users.hostname = src.hostname"
    found = o.resolved(_BY_USER, "doc_id", rules, keep=_BY_USER_KEEP, joins=joins)
    return f"""WITH {_STORED_SQL}, {HOSTS_SQL}, {_USER_PROFILE}, {found}
        SELECT doc_id, rule_id, m AS match, CAST(conf AS BIGINT) AS confidence FROM f"""


@query(
    "scan_by_user",
    _by_user_sql(o.Rules(None, [
        {"id": "c", "label": "", "category": "pii", "placeholder": "", "explanation": "", "re2": "x+"},
    ])),
)
def scan_by_user(spark, sf):
    return found_by_user(spark, sf, stored(spark, sf))


def found_by_user(spark, sf, tables):
    scanned = detect.scan_by_user(for_spark(spark, sf, "by_user"), tables, ("user_key",), as_of=st.NOW)
    found = scanned.select("doc_id", F.inline("findings"))
    return st.bigints(found.select("doc_id", "rule_id", "match", "confidence"))


@query(
    "scan_by_user_patterns",
    _by_user_sql(o.TableRules(
        f"""SELECT {len(BUILTIN_RULES)} + pos AS ord, user_key, id, trim(label) AS label, category,
              CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '(?m)' END || pattern AS re2
            FROM ({for_duckdb('user_patterns')}) WHERE enabled AND pos % 7 NOT IN (3, 4)"""
    )),
)
def scan_by_user_patterns(spark, sf):
    """A pattern for each document, each run on the texts of its user."""
    own = pol.normalize_custom(for_spark(spark, sf, "user_patterns"), ("user_key",))
    return found_by_user(spark, sf, replace(stored(spark, sf), custom_patterns=own))


@query(
    "user_patterns_refused",
    f"""SELECT pos, user_key, CASE pos % 7 WHEN 3 THEN 'refers to a group that may not have taken part'
          ELSE 'unterminated group' END AS reason FROM ({for_duckdb('user_patterns')}) WHERE pos % 7 IN (3, 4)""",
)
def user_patterns_refused(spark, sf):
    return st.bigints(refused(for_spark(spark, sf, "user_patterns")).select("pos", "user_key", "reason"))


# --- changing allow rules ----------------------------------------------------

_TEMPORARY_SQL = f"""requests AS (
  SELECT * REPLACE (CAST(floor(greatest(1.0, least(43200.0, minutes))) AS BIGINT) AS minutes)
  FROM ({for_duckdb('allow_requests')})),
temporary AS (
  SELECT * REPLACE (label || ' (temporary ' || minutes || 'm)' AS label),
    {NOW_SQL} + to_minutes(minutes) AS expires_at FROM requests)"""


@query(
    "allow_temporary",
    f"WITH {_TEMPORARY_SQL} SELECT seq, minutes, label, epoch_us(expires_at) AS expires_at FROM temporary",
)
def allow_temporary(spark, sf):
    asked = pol.temporary_allow(for_spark(spark, sf, "allow_requests"), st.NOW)
    return st.bigints(asked.select("seq", "minutes", "label", micros("expires_at")))


_KEY = "user_key, hostname, rule_id, match_fingerprint"


@query(
    "allow_upsert",
    f"""WITH {HOSTS_SQL}, {_ALLOW_SQL}, {_TEMPORARY_SQL},
asked AS (
  SELECT {_KEY}, max(seq) AS seq, arg_max(label, seq) AS label, max_by(expires_at, seq) AS expires_at,
    arg_min(id, seq) AS new_id, arg_min(created_at, seq) AS new_created FROM temporary GROUP BY {_KEY}),
stored AS (
  SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY pos) = 1),
front AS (
  SELECT a.user_key, a.hostname, a.rule_id, a.match_fingerprint, coalesce(s.id, new_id) AS id, a.label,
    coalesce(s.created_at, new_created) AS created_at, a.expires_at, -1 - seq AS pos, s.pos AS replaced
  FROM asked a LEFT JOIN stored s USING ({_KEY})),
merged AS (
  SELECT * EXCLUDE (replaced) FROM front UNION ALL
  SELECT {_KEY}, id, label, created_at, expires_at, pos FROM live p
  WHERE NOT EXISTS (SELECT 1 FROM front f WHERE f.user_key = p.user_key AND f.replaced = p.pos))
SELECT {_ALLOW_COLUMNS} FROM merged WHERE expires_at IS NULL OR expires_at > {NOW_SQL}""",
)
def allow_upsert(spark, sf):
    requests = pol.temporary_allow(for_spark(spark, sf, "allow_requests"), st.NOW)
    merged = pol.upsert_allow(live_allow(spark, sf), requests, st.NOW, ("user_key",))
    return allow_columns(merged)


@query(
    "allow_shown",
    f"""WITH {HOSTS_SQL}, {_ALLOW_SQL} SELECT user_key, pos, id FROM live
        QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY pos, id) <= 120""",
)
def allow_shown(spark, sf):
    return pol.shown_allow(live_allow(spark, sf), pol.MAX_SHOWN_ALLOW, ("user_key",)).select("user_key", "pos", "id")


@query(
    "allow_from_review",
    f"""WITH {o.resolved(for_duckdb('arriving'), 'doc_id')}, asked AS (
          SELECT hostname, rule_id, fingerprint, max(doc_id) AS seq, min(doc_id) AS first_seq, arg_min(ts, doc_id) AS ts,
            any_value(label) AS label
          FROM f JOIN src USING (doc_id) WHERE f.category = 'pii' GROUP BY hostname, rule_id, fingerprint)
        SELECT hostname, rule_id, fingerprint AS match_fingerprint, label || ' allowlisted on site' AS label,
          sha256(concat_ws(':', first_seq, hostname, fingerprint)) AS id, epoch_us(ts) AS created_at
        FROM asked""",
)
def allow_from_review(spark, sf):
    """Personal data allowed in review becomes allow rules."""
    scanned = detect.scan(for_spark(spark, sf, "arriving"))
    found = detect.explode_findings(scanned, "doc_id", "hostname", "ts", context=False).filter("category = 'pii'")
    requests = pol.allow_requests(found, seq="doc_id")
    nothing = pol.normalize_exact_allow(for_spark(spark, sf, "seeded_allow").limit(0), st.NOW)
    merged = pol.upsert_allow(nothing, requests, st.NOW)
    return merged.select("hostname", "rule_id", "match_fingerprint", "label", "id", micros("created_at"))


@query(
    "allow_extend",
    f"""WITH {HOSTS_SQL}, {_ALLOW_SQL}, labelled AS (
          SELECT * REPLACE (label || CASE WHEN pos % 2 = 0 THEN ' (Temporary 15m) ' ELSE '' END AS label),
            greatest({NOW_SQL}, coalesce(expires_at, {NOW_SQL})) AS base FROM allow)
        SELECT user_key, pos, CASE pos % 5 WHEN 0 THEN trim(regexp_replace(label, '(?i)\\s*\\(temporary[^)]*\\)\\s*$', ''))
            ELSE label END AS label,
          epoch_us(CASE pos % 5 WHEN 0 THEN NULL WHEN 1 THEN base + INTERVAL 15 MINUTE
            WHEN 2 THEN base + INTERVAL 1 HOUR WHEN 3 THEN base + INTERVAL 1 DAY ELSE expires_at END) AS expires_at
        FROM labelled""",
)
def allow_extend(spark, sf):
    allow = normalized_allow(spark, sf)
    suffix = F.when(F.col("pos") % 2 == 0, " (Temporary 15m) ").otherwise("")
    actions = F.array(*map(F.lit, ("make-permanent", "extend-15m", "extend-1h", "extend-1d", "none")))
    action = F.get(actions, (F.col("pos") % 5).cast("int"))
    extended = pol.extend_allow(allow.withColumn("label", F.concat("label", suffix)), action, st.NOW)
    return extended.select("user_key", "pos", "label", micros("expires_at"))


@query(
    "allow_expiry_report",
    f"""WITH {HOSTS_SQL}, {_ALLOW_SQL}, timed AS (
          SELECT user_key, pos, expires_at IS NULL AS permanent,
            CAST(floor((epoch_us(expires_at) - epoch_us({NOW_SQL})) / 60000000) AS BIGINT) AS n FROM allow)
        SELECT user_key, pos, CASE WHEN permanent THEN 'permanent' WHEN n <= 0 THEN 'expired'
          WHEN n < 60 THEN 'expires in ' || n || 'm'
          WHEN n < 1440 THEN 'expires in ' || (n // 60) || 'h' || CASE WHEN n % 60 > 0 THEN ' ' || (n % 60) || 'm' ELSE '' END
          ELSE 'expires in ' || (n // 1440) || 'd' END AS expiry FROM timed""",
)
def allow_expiry_report(spark, sf):
    text = pol.expiry_text(F.col("expires_at"), st.NOW)
    return normalized_allow(spark, sf).select("user_key", "pos", text.alias("expiry"))


@query(
    "policy_toggle",
    f"""WITH {_CUSTOM_SQL}, net AS (
          SELECT id, bool_or(action = 'remove') AS gone, count(*) FILTER (action = 'toggle') % 2 = 1 AS flip
          FROM ({for_duckdb('change_requests')}) GROUP BY id)
        SELECT id, label, CASE WHEN coalesce(flip, false) THEN NOT enabled ELSE enabled END AS enabled
        FROM custom LEFT JOIN net USING (id) WHERE NOT coalesce(gone, false)""",
)
def policy_toggle(spark, sf):
    changed = pol.apply_changes(normalized_custom(spark, sf), for_spark(spark, sf, "change_requests"))
    return changed.select("id", "label", "enabled")


# --- decisions and counters --------------------------------------------------

ACTION_SQL = (
    "CASE decision WHEN 'cancel' THEN 'cancelled' WHEN 'ignore-once' THEN 'ignored_once' "
    "WHEN 'allowlisted-send' THEN 'allowlisted' ELSE CASE mode WHEN 'placeholder' THEN 'safe_rewrite' "
    "WHEN 'partial-mask' THEN 'masked' ELSE 'redacted' END END"
)


@query("decision_actions", f"SELECT event_id, {ACTION_SQL} AS action FROM ({for_duckdb('decisions')})")
def decision_actions(spark, sf):
    action = pol.decision_action(F.col("decision"), F.col("mode"))
    return for_spark(spark, sf, "decisions").select("event_id", action.alias("action"))


@query(
    "mode_label",
    f"""SELECT event_id, CASE mode WHEN 'placeholder' THEN 'Safe rewrite' WHEN 'partial-mask' THEN 'Mask'
        WHEN 'full-redact' THEN 'Full redact' ELSE 'Rewrite' END AS label FROM ({for_duckdb('decisions')})""",
)
def mode_label(spark, sf):
    return for_spark(spark, sf, "decisions").select("event_id", pol.mode_label(F.col("mode")).alias("label"))


@query(
    "policy_counters",
    f"""WITH {_PROFILES_SQL}, {_CUSTOM_SQL}, {_WORKSPACE_SQL}, {_ALLOW_SQL}
        SELECT (SELECT count(*) FROM profiles WHERE enabled) AS enabled_sites,
          (SELECT count(*) FROM custom) AS custom_rules,
          (SELECT count(*) FROM workspace) + (SELECT count(*) FROM live) AS allow_rules,
          (SELECT count(*) FROM ({for_duckdb('raw_log')})) AS log_size""",
)
def policy_counters(spark, sf):
    return pol.policy_counters(
        profiles_normalized(spark, sf), normalized_custom(spark, sf), normalized_workspace(spark, sf),
        live_allow(spark, sf), for_spark(spark, sf, "raw_log"),
    )

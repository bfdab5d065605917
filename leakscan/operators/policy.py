"""Site profiles, allow rules, user patterns and the decisions made on findings.

The tables may hold the settings of one user or of many: pass the columns that
identify a user as ``by`` and every cap and lookup is applied per user.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.functions import regex, text as tx
from leakscan.operators import rules as catalogue
from leakscan.sources.shared import stored

# --- Fixed values ------------------------------------------------------------
SITES = {
    "chatgpt.com": "ChatGPT",
    "chat.openai.com": "ChatGPT",
    "claude.ai": "Claude",
    "gemini.google.com": "Gemini",
}
THRESHOLDS = {"relaxed": 75, "balanced": 58, "strict": 38}
MODES = ("placeholder", "partial-mask", "full-redact")
MODE_LABELS = {"placeholder": "Safe rewrite", "partial-mask": "Mask", "full-redact": "Full redact"}
MODE_ACTIONS = {"placeholder": "safe_rewrite", "partial-mask": "masked", "full-redact": "redacted"}
DECISION_ACTIONS = {"cancel": "cancelled", "allowlisted-send": "allowlisted", "ignore-once": "ignored_once"}
DEFAULT_MODE = "placeholder"
MAX_EXACT_ALLOW = 200
MAX_WORKSPACE_ALLOW = 100
MAX_PACKS = 24
MAX_SHOWN_ALLOW = 120
MAX_TEMPORARY_MINUTES = 43_200
EXTENSIONS = {"extend-15m": 15, "extend-1h": 60, "extend-1d": 1440}

PROFILE_SCHEMA = (
    "hostname string, label string, enabled boolean, strictness string, "
    "scan_on_paste boolean, scan_attachments boolean, redaction_mode string"
)


@dataclass
class Policy:
    """What one scan is told: toggles and the (normalised) settings tables."""

    enabled: bool = True
    detect_secrets: bool = True
    detect_pii: bool = True
    scan_on_paste: bool = True
    scan_attachments: bool = True
    default_mode: str = DEFAULT_MODE
    profiles: DataFrame | None = None
    custom_patterns: DataFrame | None = None
    exact_allow: DataFrame | None = None
    workspace_allow: DataFrame | None = None
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    def rules(self, spark: SparkSession) -> list[catalogue.Rule]:
        if "rules" not in self._memo:
            chosen = catalogue.select_rules(self.detect_secrets, self.detect_pii)
            if self.custom_patterns is not None:
                # The patterns of one policy are configuration: they become expressions of the plan.
                chosen += catalogue.custom_rules(spark, self.custom_patterns.collect())
            self._memo["rules"] = chosen or [catalogue.NO_RULE]
        return self._memo["rules"]

    def workspace_columns(self, spark: SparkSession) -> list[str]:
        """The enabled workspace patterns that compile, in Java syntax."""
        if self.workspace_allow is None:
            return []
        if "workspace" not in self._memo:
            rows = self.workspace_allow.filter("enabled").collect()
            java = [catalogue.usable(spark, r["pattern"], regex.sanitize_flags(r["flags"] or "")) for r in rows]
            self._memo["workspace"] = [p for p in java if p is not None]
        return self._memo["workspace"]

    def profile_table(self, spark: SparkSession) -> DataFrame:
        return default_profiles(spark) if self.profiles is None else self.profiles

    def host_table(self, spark: SparkSession) -> DataFrame:
        """Per supported host: threshold, switches and mode; one row of each host, the first by its fields."""
        thresholds = F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))
        fields = [c for c in self.profile_table(spark).columns if c != "hostname"]
        one = (
            self.profile_table(spark)
            .filter(F.col("hostname").isin(list(SITES)))
            .groupBy("hostname")
            .agg(F.min(F.struct(*fields)).alias("p"))
            .select("hostname", "p.*")
        )
        return one.select(
            "hostname", "enabled", "scan_on_paste", "scan_attachments", "redaction_mode",
            thresholds[F.col("strictness")].alias("threshold"),
        )


def only_row(df: DataFrame, what: str):
    """The one row of a table of configuration."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one {what}")
    return rows[0]


def keep_first(df: DataFrame, n: int, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows, per user when ``by`` is given.

    Both shapes cut before they shuffle, so a user with very many rows sends
    at most ``n`` from each task.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__rank")


def moment(as_of: datetime | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def allow_key(rule_id: Column, fingerprint: Column) -> Column:
    """What an exact allow rule and a finding have to agree on."""
    return F.concat(rule_id, F.lit("\n"), fingerprint)


# --- hosts and profiles ------------------------------------------------------


def site_label(host: Column) -> Column:
    """The site's name, or the hostname where the site is not known."""
    labels = F.create_map(*(F.lit(x) for pair in SITES.items() for x in pair))
    return F.coalesce(labels[host], host)


def mode_label(mode: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in MODE_LABELS.items() for x in pair))
    return F.coalesce(labels[mode], F.lit("Rewrite"))


def default_profiles(spark: SparkSession) -> DataFrame:
    rows = [(host, label, True, "balanced", True, True, DEFAULT_MODE) for host, label in SITES.items()]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def normalize_profiles(
    given: DataFrame, by: tuple[str, ...] = (), legacy: DataFrame | None = None, users: DataFrame | None = None
) -> DataFrame:
    """A full set of profiles for every user, with defaults for what is missing.

    ``legacy`` has ``allowed_hostnames array<string>`` per user; where it is not
    null it alone decides which hosts are enabled.  ``users`` lists the users to
    cover; by default those that appear in the other tables.
    """
    if not by:
        one = F.lit(0).alias("__user")
        return normalize_profiles(
            given.select(one, "*"),
            ("__user",),
            None if legacy is None else legacy.select(one, "*"),
            given.sparkSession.range(1).select(one),
        ).drop("__user")
    if users is None:
        users = given.select(*by) if legacy is None else given.select(*by).unionByName(legacy.select(*by))
        users = users.distinct()
    # Four rows per user, from a literal: no join against a table of hosts.
    host_rows = F.explode(
        F.array(*(F.struct(F.lit(h).alias("hostname"), F.lit(s).alias("default_label")) for h, s in SITES.items()))
    )
    base = users.select(*by, host_rows.alias("h")).select(*by, "h.*")
    supported = given.filter(F.col("hostname").isin(list(SITES)))
    joined = base.join(supported, [*by, "hostname"], "left")

    def yes_unless_false(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(True)).alias(name)

    enabled = yes_unless_false("enabled")
    if legacy is not None:
        joined = joined.join(legacy.select(*by, "allowed_hostnames"), list(by), "left")
        enabled = F.coalesce(
            F.array_contains("allowed_hostnames", F.col("hostname")), F.col("enabled"), F.lit(True)
        ).alias("enabled")
    return joined.select(
        *by,
        "hostname",
        F.coalesce("label", "default_label").alias("label"),
        enabled,
        F.when(F.col("strictness").isin(*THRESHOLDS), F.col("strictness"))
        .otherwise("balanced").alias("strictness"),
        yes_unless_false("scan_on_paste"),
        yes_unless_false("scan_attachments"),
        F.when(F.col("redaction_mode").isin(*MODES), F.col("redaction_mode"))
        .otherwise(DEFAULT_MODE).alias("redaction_mode"),
    )


def guarded(
    df: DataFrame, policy: Policy, *, host_col: str = "hostname", origin_col: str | None = None
) -> DataFrame:
    """Rows on hosts where scanning is on; unknown hosts are off.

    With ``origin_col``, pastes and attachments also need their own switch, in
    the settings and in the profile.
    """
    spark = df.sparkSession
    if not policy.enabled:
        return df.filter(F.lit(False))
    hosts = policy.host_table(spark).filter("enabled")
    hosts = hosts.select(F.col("hostname").alias("__host"), "scan_on_paste", "scan_attachments")
    condition = F.col(host_col) == F.col("__host")
    if origin_col:
        origin = F.col(origin_col)
        condition = condition & (
            F.when(origin == "paste", F.lit(policy.scan_on_paste) & F.col("scan_on_paste"))
            .when(origin == "attachment", F.lit(policy.scan_attachments) & F.col("scan_attachments"))
            .otherwise(F.lit(True))
        )
    return df.join(F.broadcast(hosts), condition, "left_semi")


def profile_versions(written: DataFrame) -> DataFrame:
    """Profiles with the time from which each holds, ``since``, up to the next one of its host, ``until``.

    ``written`` has the columns of profiles and ``since``; a host that was
    written twice for one time has the later of its rows by their fields.
    """
    fields = [c for c in written.columns if c not in ("hostname", "since")]
    once = written.groupBy("hostname", "since").agg(F.max(F.struct(*fields)).alias("p")).select("hostname", "since", "p.*")
    following = F.lead("since").over(Window.partitionBy("hostname").orderBy("since"))
    return once.withColumn("until", following)


def guarded_as_of(
    df: DataFrame, policy: Policy, versions: DataFrame, *, at: str = "ts", host_col: str = "hostname",
    origin_col: str | None = None,
) -> DataFrame:
    """Rows on hosts where scanning was on at the row's own time, with the ``profile`` that held then.

    ``versions`` are those of :func:`profile_versions`.  The versions of a host,
    one array for each supported host, ride along with its texts, so the lookup
    works on a stream as well.  Rows from before the first version are off.
    """
    kept = [c for c in versions.columns if c != "hostname"]
    hosts = versions.filter(F.col("hostname").isin(list(SITES))).groupBy(F.col("hostname").alias("__host")).agg(
        F.collect_list(F.struct(*kept)).alias("__versions")
    )
    joined = df.join(F.broadcast(hosts), F.col(host_col) == F.col("__host"))
    held = F.filter("__versions", lambda v: (v.since <= F.col(at)) & (v.until.isNull() | (v.until > F.col(at))))
    profile = F.col("profile")
    on = F.lit(policy.enabled) & profile.enabled
    if origin_col:
        origin = F.col(origin_col)
        on = on & (
            F.when(origin == "paste", F.lit(policy.scan_on_paste) & profile.scan_on_paste)
            .when(origin == "attachment", F.lit(policy.scan_attachments) & profile.scan_attachments)
            .otherwise(F.lit(True))
        )
    return joined.withColumn("profile", F.get(held, F.lit(0))).drop("__host", "__versions").filter(on)


def with_mode(df: DataFrame, policy: Policy, *, host_col: str = "hostname") -> DataFrame:
    """Add ``mode``: the host's redaction mode, or the default."""
    hosts = policy.host_table(df.sparkSession).select(
        F.col("hostname").alias("__host"), F.col("redaction_mode").alias("__mode")
    )
    joined = df.join(F.broadcast(hosts), F.col(host_col) == F.col("__host"), "left")
    return joined.withColumn("mode", F.coalesce("__mode", F.lit(policy.default_mode))).drop("__host", "__mode")


# --- normalising stored settings ---------------------------------------------


def _id_or(df: DataFrame, *parts: str) -> Column:
    """The stored id, or one derived from the row where it has none."""
    derived = F.sha2(F.concat_ws("\n", *(F.col(p).cast("string") for p in parts)), 256)
    return F.coalesce(F.nullif(F.col("id"), F.lit("")), derived).alias("id")


def normalize_custom(given: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    kept = given.filter(
        F.col("label").isNotNull() & F.col("pattern").isNotNull() & F.col("category").isin("secret", "pii")
    )
    return kept.select(
        *by,
        _id_or(kept, *by, "label", "pattern", "category"),
        tx.ws_trim(F.col("label")).alias("label"),
        "pattern",
        tx.sanitize_flags(F.coalesce("flags", F.lit("g"))).alias("flags"),
        "category",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        tx.ws_trim(F.col("explanation")).alias("explanation"),
        tx.ws_trim(F.col("placeholder")).alias("placeholder"),
        # The stored order, where it is known.
        *(["pos"] if "pos" in given.columns else []),
    )


def normalize_exact_allow(given: DataFrame, as_of: datetime | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Valid allow rules; an expiry that does not parse makes a rule permanent."""
    kept = given.filter(
        F.col("hostname").isin(list(SITES))
        & F.col("rule_id").isNotNull()
        & F.col("match_fingerprint").isNotNull()
    )
    return kept.select(
        *by,
        _id_or(kept, *by, "hostname", "rule_id", "match_fingerprint", "pos"),
        F.coalesce(tx.ws_trim(F.col("label")), F.lit("Allowlisted finding")).alias("label"),
        "hostname",
        "rule_id",
        "match_fingerprint",
        F.coalesce(F.col("created_at").try_cast("timestamp"), moment(as_of)).alias("created_at"),
        F.col("expires_at").try_cast("timestamp").alias("expires_at"),
        "pos",
    )


def purge_expired(
    allow: DataFrame, as_of: datetime | None = None, by: tuple[str, ...] = (), keep: int | None = None
) -> DataFrame:
    """Live rules only, the first ``keep`` of a user in stored order, or all."""
    live = allow.filter(is_live(F.col("expires_at"), as_of))
    return live if keep is None else keep_first(live, keep, [F.col("pos"), F.col("id")], by)


def is_live(expires_at: Column, as_of: datetime | None) -> Column:
    return expires_at.isNull() | (expires_at > moment(as_of))


def normalize_workspace(given: DataFrame, by: tuple[str, ...] = (), keep: int | None = None) -> DataFrame:
    kept = given.filter(F.col("label").isNotNull() & F.col("pattern").isNotNull()).select(
        *by,
        _id_or(given, *by, "label", "pattern"),
        tx.ws_trim(F.col("label")).alias("label"),
        "pattern",
        tx.sanitize_flags(F.coalesce("flags", F.lit("g"))).alias("flags"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "pos",
    )
    return kept if keep is None else keep_first(kept, keep, [F.col("pos"), F.col("id")], by)


def normalize_packs(
    given: DataFrame, as_of: datetime | None = None, by: tuple[str, ...] = (), keep: int | None = None
) -> DataFrame:
    kept = given.filter(
        F.col("name").isNotNull() & F.col("description").isNotNull() & F.col("pattern_count").isNotNull()
    ).select(
        *by,
        _id_or(given, *by, "name", "description", "pos"),
        tx.ws_trim(F.col("name")).alias("name"),
        tx.ws_trim(F.col("description")).alias("description"),
        F.coalesce(F.col("imported_at").try_cast("timestamp"), moment(as_of)).alias("imported_at"),
        "pattern_count",
        "pos",
    )
    return kept if keep is None else keep_first(kept, keep, [F.col("pos"), F.col("id")], by)


# --- changing allow rules ----------------------------------------------------


def allow_requests(found: DataFrame, *, seq: str, ts: str = "ts") -> DataFrame:
    """Requests to allow findings on their site, from exploded findings.

    ``seq`` orders the requests.  ``found`` has ``hostname`` and a time.
    """
    return found.select(
        F.col(seq).alias("seq"),
        F.sha2(F.concat_ws(":", F.col(seq).cast("string"), "hostname", "allow_fingerprint"), 256).alias("id"),
        F.concat(F.col("label"), F.lit(" allowlisted on site")).alias("label"),
        "hostname",
        "rule_id",
        F.col("allow_fingerprint").alias("match_fingerprint"),
        F.col(ts).alias("created_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )


def shown_allow(allow: DataFrame, keep: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``keep`` allow rules of a user, as a report shows them."""
    return keep_first(allow, keep, [F.col("pos"), F.col("id")], by)


def temporary_allow(requests: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Bound the requested minutes and turn them into an expiry and a label.

    Minutes that are missing or not a number count as one.
    """
    # Clamped before the cast: a huge request must not overflow it.
    asked, one = F.col("minutes").cast("double"), F.lit(1.0)
    minutes = F.floor(
        F.greatest(F.lit(1.0), F.least(F.lit(float(MAX_TEMPORARY_MINUTES)), F.coalesce(F.nanvl(asked, one), one)))
    ).cast("int")
    return requests.withColumn("minutes", minutes).withColumns(
        {
            "expires_at": F.timestamp_add("MINUTE", F.col("minutes"), moment(as_of)),
            "label": F.concat(
                F.col("label"), F.lit(" (temporary "), F.col("minutes").cast("string"), F.lit("m)")
            ),
        }
    )


def upsert_allow(
    existing: DataFrame, requests: DataFrame, as_of: datetime | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Apply allow requests (ordered by ``seq``) to the stored rules.

    A request for a rule that is stored and live keeps its id and creation time
    and takes the new label and expiry; either way the rule moves to the front.
    Repeated requests for a key collapse to the last one first, which leaves
    one row per key to join on however often a key is asked for.

    ``pos`` orders the rules: those asked for take ``-1 - seq``, the others keep
    theirs, so nothing is numbered anew.  Later requests need a higher ``seq``;
    requests of one key and ``seq`` are expected to be equal.
    """
    key = [*by, "hostname", "rule_id", "match_fingerprint"]
    # Requests may come from a scan: they are made once, cut to a row for each key, and stored.
    asked = stored(
        requests.dropna(subset=[*key, "seq"]).groupBy(*key).agg(
            F.min(F.struct("seq", "id", "created_at")).alias("first"), F.max(F.struct("seq", "label", "expires_at")).alias("last")
        ),
        "asked",
    )
    live = existing.filter(is_live(F.col("expires_at"), as_of))
    places = live.groupBy(*key).agg(F.min("pos").alias("pos"))
    held = live.join(places, [*key, "pos"]).select(
        *key, F.col("id").alias("stored_id"), F.col("created_at").alias("stored_created"), F.col("pos").alias("replaced")
    )
    front = asked.join(held, key, "left").select(
        *key,
        F.coalesce("stored_id", "first.id").alias("id"),
        F.col("last.label").alias("label"),
        F.coalesce("stored_created", "first.created_at").alias("created_at"),
        F.col("last.expires_at").alias("expires_at"),
        (-1 - F.col("last.seq")).cast("long").alias("pos"),
    )
    replaced = held.join(asked, key, "left_semi").select(*by, F.col("replaced").alias("pos"))
    rest = existing.join(replaced, [*by, "pos"], "left_anti").withColumn("pos", F.col("pos").cast("long"))
    merged = front.unionByName(rest.select(*front.columns))
    return merged.filter(is_live(F.col("expires_at"), as_of))


def extend_allow(allow: DataFrame, action: Column, as_of: datetime | None = None) -> DataFrame:
    """Push an expiry out, or make the rule permanent."""
    now = moment(as_of)
    base = F.greatest(now, F.coalesce("expires_at", now))
    expires = F.col("expires_at")
    for name, minutes in EXTENSIONS.items():
        expires = F.when(action == name, F.timestamp_add("MINUTE", F.lit(minutes), base)).otherwise(expires)
    permanent = action == "make-permanent"
    suffix = rf"(?i)[{tx.JS_SPACE_CLASS}]*\(temporary[^)]*\)[{tx.JS_SPACE_CLASS}]*\z"
    return allow.withColumns(
        {
            "expires_at": F.when(permanent, F.lit(None)).otherwise(expires),
            "label": F.when(permanent, tx.ws_trim(F.regexp_replace("label", suffix, ""))).otherwise(F.col("label")),
        }
    )


def expiry_text(expires_at: Column, as_of: datetime | None = None) -> Column:
    """``permanent``, ``expired`` or how long a rule still runs."""
    minutes = F.timestamp_diff("MINUTE", moment(as_of), expires_at)
    hours = F.floor(minutes / 60)
    rest = minutes % 60
    return (
        F.when(expires_at.isNull(), F.lit("permanent"))
        .when(minutes <= 0, F.lit("expired"))
        .when(minutes < 60, F.format_string("expires in %dm", minutes))
        .when(
            hours < 24,
            F.concat(
                F.format_string("expires in %dh", hours),
                F.when(rest > 0, F.format_string(" %dm", rest)).otherwise(F.lit("")),
            ),
        )
        .otherwise(F.format_string("expires in %dd", F.floor(hours / 24)))
    )


def apply_changes(table: DataFrame, changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``toggle`` and ``remove`` requests, given per ``id``, to a rule table."""
    net = changes.groupBy(*by, "id").agg(
        F.max(F.col("action") == "remove").alias("__remove"),
        (F.sum(F.when(F.col("action") == "toggle", 1).otherwise(0)) % 2 == 1).alias("__flip"),
    )
    joined = table.join(net, [*by, "id"], "left").filter(~F.coalesce("__remove", F.lit(False)))
    flipped = F.when(F.coalesce("__flip", F.lit(False)), ~F.col("enabled")).otherwise(F.col("enabled"))
    return joined.withColumn("enabled", flipped).drop("__remove", "__flip")


def decision_action(decision: Column, mode: Column) -> Column:
    """The logged action for a review decision."""
    plain = F.create_map(*(F.lit(x) for pair in DECISION_ACTIONS.items() for x in pair))
    rewrite = F.create_map(*(F.lit(x) for pair in MODE_ACTIONS.items() for x in pair))
    return F.when(decision == "rewrite", F.coalesce(rewrite[mode], F.lit("redacted"))).otherwise(plain[decision])


def policy_counters(
    profiles: DataFrame, custom: DataFrame, workspace: DataFrame, exact: DataFrame, logs: DataFrame
) -> DataFrame:
    """One row of dashboard counters, from one pass over each table."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")

    union = counted(profiles.filter("enabled"), "enabled_sites")
    for df, name in (
        (custom, "custom_rules"), (workspace, "allow_rules"), (exact, "allow_rules"), (logs, "log_size"),
    ):
        union = union.unionByName(counted(df, name))
    return union.groupBy().agg(
        *(
            F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k)
            for k in ("enabled_sites", "custom_rules", "allow_rules", "log_size")
        )
    )

"""Profiles, allow rules, decisions."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from leakscan.operators import policy as pol
from leakscan.operators.policy import Policy
from leakscan.plans import settings as st

NOW = datetime(2024, 1, 15, tzinfo=timezone.utc)
ALLOW = (
    "id string, label string, hostname string, rule_id string, match_fingerprint string, created_at timestamp, "
    "expires_at timestamp, pos int"
)


def at(**delta):
    return (NOW + timedelta(**delta)).replace(tzinfo=None)


def allow(spark, *rows):
    return spark.createDataFrame(list(rows), ALLOW)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], schema).select(column.alias("v")).first().v


def test_site_and_mode_labels(spark):
    hosts = spark.createDataFrame([("claude.ai",), ("x.example",), ("chat.openai.com",)], "h string")
    assert [r[0] for r in hosts.select(pol.site_label(F.col("h"))).collect()] == ["Claude", "x.example", "ChatGPT"]
    modes = spark.createDataFrame([("placeholder",), ("partial-mask",), ("full-redact",), (None,)], "m string")
    assert [r[0] for r in modes.select(pol.mode_label(F.col("m"))).collect()] == [
        "Safe rewrite", "Mask", "Full redact", "Rewrite",
    ]


def test_guard_and_origin_gates(spark):
    profiles = st.profiles(spark)
    rows = [(h, o) for h in [*pol.SITES, "x.example"] for o in ("composer", "paste", "attachment")]
    df = spark.createDataFrame(rows, "hostname string, origin string")

    def kept(policy, **options):
        return sorted(map(tuple, pol.guarded(df, policy, **options).collect()))

    assert len(kept(Policy(profiles=profiles))) == 9
    assert len(kept(Policy())) == 12
    assert kept(Policy(enabled=False, profiles=profiles)) == []
    gated = kept(Policy(profiles=profiles), origin_col="origin")
    assert ("chat.openai.com", "paste") not in gated and ("claude.ai", "attachment") not in gated
    assert len(gated) == 7
    no_paste = kept(Policy(scan_on_paste=False), origin_col="origin")
    assert {o for _, o in no_paste} == {"composer", "attachment"}


def test_normalize_profiles(spark):
    given = spark.createDataFrame(
        [("claude.ai", None, False, "loose", None, False, "shred"), ("x.example", "X", True, "strict", True, True, None)],
        pol.PROFILE_SCHEMA,
    )
    got = {r.hostname: r for r in pol.normalize_profiles(given).collect()}
    assert set(got) == set(pol.SITES)
    c = got["claude.ai"]
    assert (c.label, c.enabled, c.strictness, c.scan_on_paste, c.scan_attachments, c.redaction_mode) == (
        "Claude", False, "balanced", True, False, "placeholder",
    )
    assert got["chatgpt.com"].enabled
    empty = pol.normalize_profiles(given.limit(0))
    assert sorted(map(tuple, empty.collect())) == sorted(map(tuple, pol.default_profiles(spark).collect()))


def test_legacy_hosts_decide_alone(spark):
    given = spark.createDataFrame([("claude.ai", None, False, None, None, None, None)], pol.PROFILE_SCHEMA)
    legacy = spark.createDataFrame([(["claude.ai", "x.example"],)], "allowed_hostnames array<string>")
    got = {r.hostname: r.enabled for r in pol.normalize_profiles(given, legacy=legacy).collect()}
    assert got == {"claude.ai": True, "chatgpt.com": False, "chat.openai.com": False, "gemini.google.com": False}
    none = spark.createDataFrame([(None,)], "allowed_hostnames array<string>")
    got = {r.hostname: r.enabled for r in pol.normalize_profiles(given, legacy=none).collect()}
    assert got["claude.ai"] is False and got["chatgpt.com"] is True


def test_purge_keeps_live_rules_up_to_a_limit_if_asked(spark):
    rows = [(f"a{n}", "x", "claude.ai", "email", f"f{n}", at(), at(days=-1) if n % 2 else None, n) for n in range(500)]
    got = pol.purge_expired(allow(spark, *rows), NOW).collect()
    assert sorted(r.pos for r in got) == list(range(0, 500, 2))
    few = pol.purge_expired(allow(spark, *rows), NOW, keep=200).collect()
    assert sorted(r.pos for r in few) == list(range(0, 400, 2))


def test_cap_applies_per_user_with_one_user_holding_most_rows(spark):
    users = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("u"),
        F.col("id").alias("pos"),
    )
    kept = pol.keep_first(users, 150, [F.col("pos")], ("u",))
    assert kept.filter("u = 'hot'").agg(F.max("pos"), F.count("*")).first()[:] == (447, 150)
    assert kept.filter("u = 'u1'").count() == users.filter("u = 'u1'").count() <= 150
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_upsert(spark):
    existing = allow(
        spark,
        ("old", "first", "claude.ai", "email", "k1", at(days=-9), None, 0),
        ("gone", "expired", "claude.ai", "email", "k2", at(days=-9), at(days=-1), 1),
        ("keep", "other", "claude.ai", "email", "k3", at(days=-9), at(days=1), 2),
        ("dup", "same key", "claude.ai", "email", "k1", at(days=-8), None, 3),
    )
    requests = spark.createDataFrame(
        [
            (1, "r1", "one", "claude.ai", "email", "k1", at(), at(days=2)),
            (2, "r2", "two", "claude.ai", "email", "k2", at(), None),
            (3, "r3", "again", "claude.ai", "email", "k1", at(), None),
        ],
        "seq int, id string, label string, hostname string, rule_id string, match_fingerprint string, "
        "created_at timestamp, expires_at timestamp",
    )
    got = pol.upsert_allow(existing, requests, NOW).orderBy("pos").collect()
    assert [(r.id, r.label, r.match_fingerprint, r.expires_at) for r in got] == [
        ("old", "again", "k1", None), ("r2", "two", "k2", None), ("keep", "other", "k3", at(days=1)),
        ("dup", "same key", "k1", None),
    ]
    assert got[0].created_at == at(days=-9) and got[1].created_at == at()


def test_upsert_makes_requests_once(spark):
    fields = (
        "seq int, id string, label string, hostname string, rule_id string, match_fingerprint string, "
        "created_at timestamp, expires_at timestamp"
    )
    rows = [
        (n, f"r{n}", f"L{n}", "claude.ai" if n != 7 else None, "email", f"k{n % 3}", at(hours=n), None if n % 2 else at(days=9))
        for n in range(12)
    ]
    costly = spark.createDataFrame(rows, fields).withColumn("label", F.reverse(F.upper("label")))
    got = pol.upsert_allow(allow(spark).limit(0), costly, NOW)
    assert "upper(" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pos, r.id, r.label, r.created_at, r.expires_at) for r in got.collect()) == [
        (-12, "r2", "11L", at(hours=2), None), (-11, "r1", "01L", at(hours=1), at(days=9)), (-10, "r0", "9L", at(hours=0), None),
    ]


@pytest.mark.parametrize("asked, minutes", [(0.5, 1), (15.9, 15), (99999.0, 43200), (-3.0, 1), (1e300, 43200), (None, 1), (float("nan"), 1)])
def test_temporary(spark, asked, minutes):
    df = spark.createDataFrame([("L", asked)], "label string, minutes double")
    r = pol.temporary_allow(df, NOW).first()
    assert (r.minutes, r.label, r.expires_at) == (minutes, f"L (temporary {minutes}m)", at(minutes=minutes))


@pytest.mark.parametrize(
    "action, expires, label, new_expires, new_label",
    [
        ("extend-15m", at(minutes=5), "L", at(minutes=20), "L"),
        ("extend-1h", at(days=-3), "L", at(hours=1), "L"),
        ("extend-1d", None, "L", at(days=1), "L"),
        ("make-permanent", at(hours=1), "L (Temporary 15m)  ", None, "L"),
        ("make-permanent", None, "(temporary a) b", None, "(temporary a) b"),
        ("other", at(hours=1), "L (temporary 1m)", at(hours=1), "L (temporary 1m)"),
    ],
)
def test_extend(spark, action, expires, label, new_expires, new_label):
    df = allow(spark, ("a", label, "claude.ai", "email", "f", at(), expires, 0))
    r = pol.extend_allow(df, F.lit(action), NOW).first()
    assert (r.expires_at, r.label) == (new_expires, new_label)


@pytest.mark.parametrize(
    "expires, text",
    [
        (None, "permanent"), (at(seconds=30), "expired"), (at(days=-2), "expired"), (at(minutes=1), "expires in 1m"),
        (at(minutes=59, seconds=59), "expires in 59m"), (at(hours=2), "expires in 2h"),
        (at(hours=23, minutes=59), "expires in 23h 59m"), (at(hours=49), "expires in 2d"),
    ],
)
def test_expiry_text(spark, expires, text):
    assert one(spark, pol.expiry_text(F.col("e"), NOW), e=(expires, "timestamp")) == text


def test_changes(spark):
    table = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True)], "id string, enabled boolean")
    changes = spark.createDataFrame(
        [("a", "toggle"), ("b", "toggle"), ("b", "toggle"), ("c", "remove"), ("c", "toggle"), ("zz", "remove")],
        "id string, action string",
    )
    got = pol.apply_changes(table, changes).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", False), ("b", False), ("d", True)]


@pytest.mark.parametrize(
    "decision, mode, action",
    [
        ("cancel", None, "cancelled"), ("ignore-once", None, "ignored_once"), ("allowlisted-send", None, "allowlisted"),
        ("rewrite", "placeholder", "safe_rewrite"), ("rewrite", "partial-mask", "masked"),
        ("rewrite", "full-redact", "redacted"),
    ],
)
def test_decisions(spark, decision, mode, action):
    column = pol.decision_action(F.col("d"), F.col("m"))
    assert one(spark, column, d=(decision, "string"), m=(mode, "string")) == action


def test_normalize_custom_and_workspace_and_packs(spark):
    given = spark.createDataFrame(
        [
            ("", " A ", "x", "ggz", "secret", None, " e ", None), ("i", "B", "y", None, "pii", False, None, " <B> "),
            ("j", "C", "z", "g", "other", True, None, None), ("k", None, "z", "g", "pii", True, None, None),
        ],
        st.PATTERN_SCHEMA,
    )
    a, b = pol.normalize_custom(given).orderBy("label").collect()
    assert (a.label, a.flags, a.enabled, a.explanation, len(a.id)) == ("A", "g", True, "e", 64)
    assert (b.id, b.flags, b.enabled, b.placeholder) == ("i", "g", False, "<B>")
    many = spark.range(300).selectExpr(
        "cast(id as string) id", "'l' label", "'p' pattern", "'g' flags", "true enabled", "id pos"
    )
    assert pol.normalize_workspace(many).agg(F.max("pos")).first()[0] == 299
    assert pol.normalize_workspace(many, keep=100).agg(F.max("pos")).first()[0] == 99
    packs = spark.range(60).selectExpr(
        "cast(id as string) id", "' n ' name", "'d' description", "'2024-01-01' imported_at", "id pattern_count", "id pos"
    )
    kept = pol.normalize_packs(packs, NOW, keep=24).collect()
    assert len(kept) == 24 and kept[0]["name"] == "n"


def test_counters(spark):
    rows = spark.range(3)
    got = pol.policy_counters(pol.default_profiles(spark), rows, rows, rows, rows.limit(0)).first()
    assert got.asDict() == dict(enabled_sites=4, custom_rules=3, allow_rules=6, log_size=0)

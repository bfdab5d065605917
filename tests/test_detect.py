"""Rules, scoring, suppression, thresholds and overlap resolution."""

import random
import time
from dataclasses import replace
from datetime import datetime, timezone
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from leakscan.operators import allow as allow_rules
from leakscan.operators import detect
from leakscan.operators import policy as pol
from leakscan.operators.policy import Policy
from leakscan.operators.rules import BUILTIN_RULES, NO_GATE
from leakscan.plans import settings as st

H = md5(b"42").hexdigest()
NOW = datetime(2024, 1, 15, tzinfo=timezone.utc)

# One text per rule: made from parts, so that none of them is in this file.
SNIPPETS = {
    "openai-key": ("sk-" + H, 88, "high"),
    "aws-access-key": ("AKIA" + H[:16].upper(), 86, "high"),
    "github-token": ("ghp_" + H, 92, "critical"),
    "gitlab-token": ("glpat-" + H, 99, "critical"),
    "sendgrid-api-key": ("SG." + H[:22] + "." + H + H[:11], 99, "critical"),
    "twilio-account-sid": ("AC" + H, 68, "high"),
    "twilio-api-key-sid": ("SK" + H, 68, "high"),
    "twilio-auth-token": ("TWILIO_AUTH_TOKEN: " + H, 99, "critical"),
    "slack-token": ("xoxb-" + H, 92, "critical"),
    "stripe-secret-key": ("sk_live_" + H, 92, "critical"),
    "google-api-key": ("maps " + "AIza" + H + H[:3], 96, "critical"),
    "firebase-api-key": ("firebase config " + "AIza" + H + H[:3], 98, "critical"),
    "gcp-service-account-private-key-id": ('"private_key_id": "' + H + '"', 99, "critical"),
    "gcp-service-account-client-email": ('"client_email": "' + H[:8] + '@p.iam.gserviceaccount.com"', 96, "critical"),
    "jwt": (f"eyJ{H}.{H}.{H}", 86, "high"),
    "pem-private-key": (f"-----BEGIN {'PRIVATE'} KEY-----\n{H}\n-----END {'PRIVATE'} KEY-----", 99, "critical"),
    "bearer-token": ("Bearer " + H, 99, "critical"),
    "auth-header": ("Authorization: Basic " + H, 99, "critical"),
    "env-assignment": ("API_KEY=" + H, 99, "critical"),
    "connection-string-password": ("postgres://u:" + H[:12] + "@db/x", 99, "critical"),
    "azure-storage-connection-string-key": (
        f"DefaultEndpointsProtocol=https;AccountName=a;AccountKey={H};EndpointSuffix=core.windows.net", 99, "critical"),
    "azure-servicebus-connection-string-key": (
        f"Endpoint=sb://a/;SharedAccessKeyName=k;SharedAccessKey={H}", 99, "critical"),
    "azure-sas-token-sig": ("sv=2024-01-01&sig=" + H, 99, "critical"),
    "kv-secret-value": ("password=" + H, 92, "critical"),
    "email": (H[:8] + "@example.com", 76, "medium"),
    "phone": ("call +1 415 555 0042", 74, "medium"),
}


def test_catalogue():
    assert len(BUILTIN_RULES) == 26
    assert [r.id for r in BUILTIN_RULES] == list(SNIPPETS)
    assert sum(r.category == "pii" for r in BUILTIN_RULES) == 2


def test_each_rule_on_its_own_line(scan_all):
    results = scan_all(["before\n" + s + "\nafter" for s, _, _ in SNIPPETS.values()])
    for (rule, (_, confidence, severity)), found in zip(SNIPPETS.items(), results):
        assert [(f.rule_id, f.confidence, f.severity) for f in found] == [(rule, confidence, severity)], rule


@pytest.mark.parametrize(
    "text, winner, confidence",
    [
        ("GITHUB_TOKEN=" + "ghp_" + H, "github-token", 99),
        ("Authorization: Bearer " + H, "bearer-token", 99),
        (f"Authorization: Bearer eyJ{H}.{H}.{H}", "jwt", 99),
        ("AIza" + H + H[:3], "google-api-key", 90),
        ("firebase config apiKey: " + "AIza" + H + H[:3], "google-api-key", 99),
        ("pwd=abc", "kv-secret-value", 74),
        ("pwd=" + H, "kv-secret-value", 78),
    ],
)
def test_overlap_winner(scan_all, text, winner, confidence):
    (found,) = scan_all([text])
    assert [(f.rule_id, f.confidence) for f in found] == [(winner, confidence)]


def ids(found):
    return [f.rule_id for f in found]


def test_edge_cases(scan_all):
    cases = {
        "\u00e9AKIA" + H[:16].upper(): ["aws-access-key"],
        "233.233.171.252": [],
        "call 1234 5678 9012 3456": [],
        "x1234567890": [],
        "ring 415 555 0042 now": ["phone"],
        "415 555 0042": ["phone"],
        "a\rAPI_KEY=short": ["env-assignment"],
        "a\u0085API_KEY=short": [],
        "secret=1": ["kv-secret-value"],
        "xsecret=1": [],
        "": [],
        " \u00a0\n": [],
        "password=\nnext": ["kv-secret-value"],
        "a@b.co c@d.org": ["email", "email"],
    }
    for (text, expected), found in zip(cases.items(), scan_all(list(cases))):
        assert ids(found) == expected, text


def test_relaxed_drops_weak_findings(scan_all):
    texts = ["pwd=abc", "call 415 555 0042", "AC" + H, "password=" + H]
    assert [ids(f) for f in scan_all(texts, strictness="relaxed")] == [[], [], [], ["kv-secret-value"]]
    assert scan_all(texts, strictness="strict") == scan_all(texts, strictness="balanced")


def test_spans_at_both_ends_and_multi_line_context(spark):
    key = SNIPPETS["pem-private-key"][0]
    df = spark.createDataFrame([(1, key), (2, "x\n  a " + key + " z \ny")], "doc_id int, text string")
    rows = detect.explode_findings(detect.scan(df), "doc_id").orderBy("doc_id").collect()
    assert (rows[0].start_pos, rows[0].end_pos, rows[0].context) == (0, len(key), key)
    assert rows[1].context == "a " + key + " z"
    assert rows[1].match == key and rows[1].start_pos == 6


def test_match_length_bonus(scan_all):
    short, long = scan_all(["password=" + "x" * 23, "password=" + "x" * 24])
    assert (short[0].confidence, long[0].confidence) == (88, 92)
    assert (short[0].severity, long[0].severity) == ("high", "critical")


def test_why(scan_all):
    (found,) = scan_all(["secret token password=" + "x" * 30])
    why = found[0].why
    assert len(why) == 3
    assert why[1] == 'Nearby context references "password", which increases confidence that this is live data.'
    assert why[2] == detect.WHY_LONG
    (plain,) = scan_all(["ring 415 555 0042"])
    assert plain[0].why == ["This number looks like a phone number and may expose personal contact details."]
    (sure,) = scan_all(["API_KEY=abc"])
    assert sure[0].why[-1] == detect.WHY_CONFIDENT


def test_sentinel_characters_do_not_move_offsets(scan_all):
    text = "\ue000\ue001 a@b.co \ue001"
    (found,) = scan_all([text])
    assert text[found[0].start_pos : found[0].end_pos] == found[0].match == "a@b.co"


def test_labels_and_severity(spark):
    rows = spark.createDataFrame([(s, c) for s in (True, False) for c in (1, 59, 60, 79, 80, 81, 82, 89, 90)], "s boolean, c int")
    for r in rows.select(
        "s", "c", detect.severity(F.col("s"), F.col("c")).alias("sev"), detect.confidence_label(F.col("c")).alias("l")
    ).collect():
        expected = ("critical" if r.c >= 90 else "high") if r.s else ("high" if r.c >= 82 else "medium")
        assert r.sev == expected
        assert r.l == ("high" if r.c >= 80 else "medium" if r.c >= 60 else "low")


# --- custom rules ------------------------------------------------------------


def custom(spark, *patterns):
    rows = [(f"c{n}", f"Custom {n}", p, flags, "secret", True, None, None) for n, (p, flags) in enumerate(patterns)]
    return pol.normalize_custom(spark.createDataFrame(rows, st.PATTERN_SCHEMA))


def test_custom_rules(spark, scan_all):
    patterns = custom(spark, ("a*", "g"), ("(", "g"), (r"(\w)\1{5}", "g"), (r"^\s*total", "im"))
    policy = Policy(detect_secrets=False, detect_pii=False, custom_patterns=patterns)
    empty, starred, repeated, anchored, mail = scan_all(
        ["bcd", "xaay", "zzzzzz", "x\n  TOTAL 1", "a@b.co"], policy
    )
    assert empty == []
    assert [f.match for f in starred] == ["aa"]
    assert [(f.rule_id, f.confidence, f.source) for f in repeated] == [("c2", 82, "custom")]
    assert [f.match for f in anchored] == ["\n  TOTAL"] or [f.match for f in anchored] == ["  TOTAL"]
    assert ids(mail) == ["c0"]
    assert repeated[0].placeholder == "<CUSTOM_2>"
    assert repeated[0].explanation == 'This matches the custom pattern "Custom 2".'


def test_custom_match_that_opens_the_text_with_a_line_feed(spark):
    policy = Policy(False, False, False, custom_patterns=custom(spark, (r"\nx", "g")))
    df = spark.createDataFrame([(1, "\nx y\nz")], "doc_id int, text string")
    (row,) = detect.explode_findings(detect.scan(df, policy), "doc_id").collect()
    assert (row.match, row.context) == ("\nx", "x y")


def test_nothing_switched_on(scan_all):
    assert scan_all(["a@b.co"], Policy(detect_secrets=False, detect_pii=False)) == [[]]


def test_toggles(scan_all):
    text = "a@b.co\npassword=abc"
    assert ids(scan_all([text], Policy(detect_secrets=False))[0]) == ["email"]
    assert ids(scan_all([text], Policy(detect_pii=False))[0]) == ["kv-secret-value"]


# --- allow rules -------------------------------------------------------------


def allow(spark, *rows):
    schema = (
        "id string, label string, hostname string, rule_id string, match_fingerprint string, "
        "created_at string, expires_at string, pos int"
    )
    full = [(f"a{n}", "x", *r[:3], "2024-01-01", r[3], n) for n, r in enumerate(rows)]
    return pol.normalize_exact_allow(spark.createDataFrame(full, schema), NOW)


@pytest.mark.parametrize(
    "expires, active",
    [(None, True), ("2024-01-14 00:00:00", False), ("2024-01-15 00:00:00", False), ("2024-01-15 00:00:01", True), ("soon", True)],
)
def test_exact_allow_expiry(spark, scan_all, expires, active):
    rules = allow(spark, ("claude.ai", "email", "email:a@b.co", expires))
    texts = [("a@b.co", "claude.ai"), ("a@b.co", "chatgpt.com"), ("a@b.co", "elsewhere.example")]
    here, other, unknown = scan_all(texts, Policy(exact_allow=rules), as_of=NOW)
    assert ids(here) == ([] if active else ["email"])
    assert ids(other) == ids(unknown) == ["email"]


def test_allowing_the_winner_reveals_the_runner_up(spark, scan_all):
    token = "ghp_" + H
    rules = allow(spark, ("claude.ai", "github-token", "github-token:" + token, None))
    texts = [("GITHUB_TOKEN=" + token, "claude.ai")]
    policy = Policy(exact_allow=rules)
    assert ids(scan_all(texts, policy, as_of=NOW)[0]) == ["env-assignment"]
    assert ids(scan_all(texts, policy, as_of=NOW, ignore_allow=True)[0]) == ["github-token"]


def test_exact_allow_needs_a_hostname(spark, scan_all):
    rules = allow(spark, ("claude.ai", "email", "email:a@b.co", None))
    assert ids(scan_all(["a@b.co"], Policy(exact_allow=rules), as_of=NOW)[0]) == ["email"]


def workspace(spark, *rows):
    full = [(f"w{n}", "x", p, flags, on, n) for n, (p, flags, on) in enumerate(rows)]
    schema = "id string, label string, pattern string, flags string, enabled boolean, pos int"
    return pol.normalize_workspace(spark.createDataFrame(full, schema))


def test_workspace_allow(spark, scan_all):
    patterns = workspace(spark, ("(", "g", True), ("@test\\.", "g", True), ("^DEMO", "i", True), ("a@b", "g", False))
    texts = ["x@test.com", "demo line x@b.co", "line\ndemo x@b.co", "a@b.co", "no demo x@b.co"]
    found = scan_all(texts, Policy(workspace_allow=patterns))
    assert [ids(f) for f in found] == [[], [], [], ["email"], ["email"]]
    assert ids(scan_all(["x@test.com"], Policy(workspace_allow=patterns), ignore_allow=True)[0]) == ["email"]


def test_profile_strictness(spark, scan_all):
    profiles = spark.createDataFrame(
        [("claude.ai", "C", True, "relaxed", True, True, "placeholder")], pol.PROFILE_SCHEMA
    )
    texts = [("pwd=abc", "claude.ai"), ("pwd=abc", "other.example"), ("pwd=abc", None)]
    strict, other, none = scan_all(texts, Policy(profiles=profiles))
    assert (ids(strict), ids(other), ids(none)) == ([], ["kv-secret-value"], ["kv-secret-value"])
    forced = scan_all(texts, Policy(profiles=profiles), strictness="balanced")
    assert [ids(f) for f in forced] == [["kv-secret-value"]] * 3


def test_any_number_of_exact_rules_is_used(spark, scan_all):
    rows = [(f"a{n}", "x", "claude.ai", "email", f"email:u{n}@b.co", None, None, n) for n in range(900)]
    schema = (
        "id string, label string, hostname string, rule_id string, match_fingerprint string, created_at timestamp, "
        "expires_at timestamp, pos int"
    )
    policy = Policy(exact_allow=spark.createDataFrame(rows, schema))
    texts = [("u899@b.co and u900@b.co", "claude.ai"), ("u899@b.co", "chatgpt.com"), ("u1@b.co", "claude.ai"), (None, None)]
    found = scan_all(texts + texts[:1], policy)
    assert [[f.match for f in row] for row in found] == [["u900@b.co"], ["u899@b.co"], [], [], ["u900@b.co"]]


@pytest.mark.parametrize("carried", [allow_rules.MOST_CARRIED, 3, 0])
def test_rules_hold_at_the_time_of_each_text(spark, monkeypatch, carried):
    """Against a plain loop, with the rules in the row, joined, and some of each."""
    monkeypatch.setattr(allow_rules, "MOST_CARRIED", carried)
    draw = random.Random(8)
    day = lambda n: datetime(2024, 1, 1 + n, tzinfo=timezone.utc)
    rules = []
    for n in range(40):
        start, end = draw.randint(0, 27), draw.choice([None, draw.randint(0, 27)])
        host = draw.choice(["claude.ai", "claude.ai", "chatgpt.com", "elsewhere.example"])
        rules.append((host, f"u{draw.randint(0, 5)}@b.co", start, end))
    schema = (
        "id string, label string, hostname string, rule_id string, match_fingerprint string, created_at timestamp, "
        "expires_at timestamp, pos int"
    )
    rows = [(f"a{n}", "x", h, "email", f"email:{v}", day(a), None if b is None else day(b), n) for n, (h, v, a, b) in enumerate(rules)]
    rows.append(("p", "x", "gemini.google.com", "email", "email:u1@b.co", None, None, 99))
    policy = Policy(exact_allow=spark.createDataFrame(rows, schema))
    texts = [
        (k, " ".join(f"u{n}@b.co" for n in range(7)), draw.choice(["claude.ai", "chatgpt.com", "gemini.google.com", "elsewhere.example", None]),
         day(draw.randint(0, 27)))
        for k in range(60)
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string, hostname string, ts timestamp").repartition(3)
    found = {r.doc_id: [f.match for f in r.findings] for r in detect.scan(df, policy, host_col="hostname", at="ts").collect()}

    def covered(host, value, now):
        if host == "gemini.google.com" and value == "u1@b.co":
            return True
        own = [r for r in rules if r[:2] == (host, value) and host != "elsewhere.example"]
        return any(day(a) <= now and (b is None or now < day(b)) for _, _, a, b in own)

    assert found == {k: [v for v in text.split() if not covered(host, v, ts)] for k, text, host, ts in texts}


def test_what_a_match_begins_with_loses_none(spark):
    """The pattern of a structured secret, with and without the look at its first characters."""
    draw = random.Random(3)
    parts = ["password", "PWD", "client_secret", "Secret", "token", "=", " = ", ";", " ", "\n", "\r", "\u2028", "\u00a0", "x", "é", "\u017f", "😀", "p", "se"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    rule = next(r for r in BUILTIN_RULES if r.id == "kv-secret-value")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = replace(rule, source="checked")
    assert df.filter(rule.marked(F.col("text")) != plain.marked(F.col("text"))).count() == 0
    assert df.filter(rule.marked(F.col("text")) != F.col("text")).count() > 50


def test_texts_of_crowded_hosts_are_not_shuffled(spark, monkeypatch):
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    stored = allow_rules.stored
    monkeypatch.setattr(allow_rules, "stored", noted)
    monkeypatch.setattr(allow_rules, "MOST_CARRIED", 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rules = [(f"a{n}", "x", "claude.ai", "email", f"email:u{n}@b.co", None, None, n) for n in range(5)]
        schema = (
            "id string, label string, hostname string, rule_id string, match_fingerprint string, created_at timestamp, "
            "expires_at timestamp, pos int"
        )
        texts = [(n, f"u{n}@b.co", "claude.ai" if n < 7 else "chatgpt.com") for n in range(9)]
        df = spark.createDataFrame(texts, "doc_id int, text string, hostname string")
        found = detect.scan(df, Policy(exact_allow=spark.createDataFrame(rules, schema)), host_col="hostname")
        assert {r.doc_id: len(r.findings) for r in found.collect()} == {n: int(n > 4) for n in range(9)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plans["scored"] and "SortMergeJoin" not in plans["scored"]


def test_times_that_touch_are_one(spark):
    schema = "hostname string, rule_id string, match_fingerprint string, created_at timestamp, expires_at timestamp"
    at = lambda n: datetime(2024, 1, n)
    rows = [("h", "r", "a", at(1), at(3)), ("h", "r", "a", at(3), at(4)), ("h", "r", "a", at(2), at(3)), ("h", "r", "a", at(6), None),
            ("h", "r", "a", at(7), at(8)), ("h", "r", "b", None, at(2)), ("h", "r", "c", at(5), at(5))]
    found = allow_rules.intervals(spark.createDataFrame(rows, schema), ["hostname"], timed=True)
    found = found.select("key", F.col("since").cast("string"), F.col("until").cast("string")).collect()
    assert sorted(map(tuple, found)) == [
        ("r\na", str(at(1)), str(at(4))), ("r\na", str(at(6)), allow_rules.NEVER), ("r\nb", allow_rules.EVER, str(at(2))),
    ]


# --- overlaps ----------------------------------------------------------------


def brute_force(findings):
    def score(f):
        weight = 2000 if f["secret"] and f["confidence"] >= 90 else 1000 if f["secret"] or f["confidence"] >= 82 else 100
        return weight + f["confidence"] + f["ending"] - f["start"]

    kept = []
    for f in sorted(findings, key=lambda f: (f["start"], -score(f), f["ord"])):
        if not kept or f["start"] >= kept[-1]["ending"]:
            kept.append(f)
        elif score(f) > score(kept[-1]):
            kept[-1] = f
    return [(f["start"], f["ending"], f["ord"]) for f in kept]


def finding(start, ending, ord, confidence, secret):
    return dict(
        start=start, ending=ending, ord=ord, match="m", first_line=0, last_line=0, confidence=confidence, keyword=None,
        secret=secret,
    )


def resolve(spark, lists):
    df = spark.createDataFrame(list(enumerate(lists)), f"k int, raw array<{detect._FINDING}>")
    rows = df.select("k", detect.resolve_overlaps(F.col("raw")).alias("f")).orderBy("k").collect()
    return [[(f.start, f.ending, f.ord) for f in r.f] for r in rows]


def test_replacement_can_lose_coverage(spark):
    lists = [
        [finding(0, 10, 0, 60, False), finding(5, 8, 1, 99, True), finding(8, 9, 2, 99, True)],
        [finding(0, 5, 0, 60, False), finding(5, 9, 1, 60, False)],
        [],
    ]
    assert resolve(spark, lists) == [[(5, 8, 1), (8, 9, 2)], [(0, 5, 0), (5, 9, 1)], []]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    lists = []
    for n in [1, 2, 3, 5, 8, 20] * 12 + [300, 700]:
        raw, used = [], set()
        for _ in range(n):
            start, ord = rng.randint(0, 3 * n), rng.randint(0, 5)
            if (start, ord) not in used:
                used.add((start, ord))
                raw.append(finding(start, start + rng.randint(1, 8), ord, rng.choice([60, 75, 82, 90, 99]), rng.random() < 0.6))
        lists.append(raw)
    assert resolve(spark, lists) == [brute_force(raw) for raw in lists]


# --- properties over random texts --------------------------------------------


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(11)
    parts = [s for s, _, _ in SNIPPETS.values()] + [
        "\n", "\n", " ", " ", "; ", "=", ":", "token", "pwd=", "path ", "\u00e9", "\u00a0", "\r\n", "+1 (415) 555-0042",
        "10.0.0.1", "BEARER abcdefghijklmnop", "x" * 30, "Authorization:", "a@b.co", "secret = 'q'", "https://h/p?sig=1&sv=2",
    ]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(300)]


def test_spans_sorted_disjoint_and_exact(scan_all, random_texts):
    total = 0
    for text, found in zip(random_texts, scan_all(random_texts)):
        end = 0
        for f in found:
            assert f.start_pos >= end and text[f.start_pos : f.end_pos] == f.match
            assert 1 <= f.confidence <= 99
            end = f.end_pos
            total += 1
    assert total > 1000


def test_gates_change_nothing(spark, random_texts):
    df = spark.createDataFrame(list(enumerate(random_texts)), "doc_id int, text string")

    def hits(rules):
        rows = detect.raw_findings(df, rules=rules).select("doc_id", F.inline("findings"))
        return sorted(map(tuple, rows.select("doc_id", "rule_id", "start_pos", "end_pos", "confidence").collect()))

    ungated = [replace(rule, gate=NO_GATE) for rule in BUILTIN_RULES]
    gated = hits(list(BUILTIN_RULES))
    assert len(gated) > 1000 and gated == hits(ungated)


def test_context_is_the_line(spark, random_texts):
    df = spark.createDataFrame(list(enumerate(random_texts)), "doc_id int, text string")
    spaces = " \t\n\r\x0b\x0c\u00a0\ufeff"
    for r in detect.explode_findings(detect.raw_findings(df), "doc_id").collect():
        text = random_texts[r.doc_id]
        start = max(0, text.rfind("\n", 0, max(0, r.start_pos - 1) + 1) + 1)
        stop = text.find("\n", r.end_pos)
        assert r.context == text[start : len(text) if stop < 0 else stop].strip(spaces)


def test_many_findings_in_one_document(spark):
    for sep in ("\n", " "):
        text = sep.join(f"user{i}@example.com" for i in range(3000))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        found = detect.scan(df).first().findings
        assert len(found) == 3000
        assert all(text[f.start_pos : f.end_pos] == f.match for f in found)


def test_summary(spark):
    df = spark.createDataFrame(
        [(0, "a@b.co\npassword=abc\nc@d.org"), (1, "nothing"), (2, "a@b.co\npassword=abc")], "doc_id int, text string"
    )
    s = detect.scan(df).orderBy("doc_id").select(detect.summarize(F.col("findings")).alias("s")).collect()
    assert s[0].s.asDict() == dict(
        total=3, secrets=1, pii=2, critical=0, high_confidence=1,
        rule_labels=["Email address", "Structured secret value"], top_category="pii",
    )
    assert (s[1].s.total, s[1].s.rule_labels, s[1].s.top_category) == (0, [], None)
    assert s[2].s.top_category == "secret"


@pytest.mark.parametrize(
    "rule_id, pieces",
    [
        ("email", ["a", "b1", ".", "@", "-", "%", "+", "_", " ", "\n", ".co", ".c", "\u00e9", "@x.org", ".", "@"]),
        (
            "env-assignment",
            ["API_KEY", "github_token", "=", "=", "\n", "\r", "\r\n", " ", "\t", "\u2028", "\u00a0", "\u0085", "'", '"', "v1", "\n"],
        ),
    ],
)
def test_one_pass_patterns_find_the_same(spark, rule_id, pieces):
    rng = random.Random(rule_id)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rule = next(r for r in BUILTIN_RULES if r.id == rule_id)

    def hits(r):
        rows = detect.raw_findings(df, rules=[r]).select("doc_id", F.inline("findings"))
        return sorted(map(tuple, rows.select("doc_id", "start_pos", "end_pos").collect()))

    as_written = hits(replace(rule, source="custom"))
    assert len(as_written) > 500
    assert hits(rule) == as_written


def test_long_runs_take_linear_time(spark):
    texts = ["x_key=\n" + "\n" * 200_000, "@ " + "a." * 100_000, "token = a\n" + " " * 200_000, "1 2 3 " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    start = time.monotonic()
    detect.scan(df).select(F.size("findings")).collect()
    assert time.monotonic() - start < 60

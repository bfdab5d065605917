"""Sources, rule packs, attachments, incident log."""

import json
import random
from datetime import datetime, timedelta, timezone
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from leakscan.functions import typed
from leakscan.operators import attachments as att
from leakscan.operators import detect
from leakscan.operators import incidents as inc
from leakscan.operators import policy as pol
from leakscan.operators import rulepacks as packs
from leakscan.operators.policy import Policy
from leakscan.sources import files as files_source
from leakscan.sources import logs, settings, shared, tables

NOW = datetime(2024, 1, 15, tzinfo=timezone.utc)
FILES = (
    "input_id string, batch_ts timestamp, file_name string, file_type string, size bigint, mtime timestamp, text string"
)


def at(**delta):
    return (NOW + timedelta(**delta)).replace(tzinfo=None)


def file(input_id="i", batch=0, name="a.txt", kind=None, text="x", size=1):
    return (input_id, at(hours=batch), name, kind, size, at(), text)


# --- sources -----------------------------------------------------------------


def test_composer_texts(spark):
    df = spark.createDataFrame([(1, "a\u00a0b"), (2, " \u00a0\n"), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in tables.composer_texts(df).collect()] == [(1, "a b")]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbf\xff mail a@b.co")
    (tmp_path / "sub" / "b.env").write_text("x\nAPI_KEY=abc")
    (tmp_path / "c.png").write_bytes(b"a@b.co")
    read = files_source.read_files(spark, str(tmp_path), input_id="one", batch_ts=NOW)
    assert att.latest_selection(read).count() == 2
    assert {r.file_name: r.text for r in read.collect()} == {"a.TXT": "\ufffd mail a@b.co", "b.env": "x\nAPI_KEY=abc"}
    found = att.scan_files(read).select(F.inline("findings")).collect()
    assert {(r.file_name, r.rule_id, r.file_type) for r in found} == {
        ("a.TXT", "email", "text/plain"), ("b.env", "env-assignment", "text/plain"),
    }


def test_shared_folder_comes_from_the_session(spark):
    folder = shared.shared_folder(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert folder != shared.shared_folder(spark, "x")


# --- rule packs --------------------------------------------------------------

PACK = {
    "name": "P", "description": "D",
    "patterns": [
        {"label": " A ", "pattern": "a+", "category": "secret", "explanation": " ", "placeholder": " <A> "},
        {"label": "B", "pattern": "b", "flags": "ggi", "category": "other"},
        {"label": "C", "category": "pii"},
        {"pattern": "d", "category": "pii"},
        "text",
        7,
    ],
}


def test_import(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(PACK, indent=2))
    read = packs.read_packs(spark, str(tmp_path / "p.json"))
    a, b = packs.imported_patterns(read).orderBy("label").collect()
    assert (a.label, a.flags, a.enabled, a.explanation, a.placeholder) == ("A", "g", True, None, "<A>")
    assert (b.flags, b.category) == ("gi", "other")
    # The count is taken before unusable categories are dropped.
    assert packs.imported_meta(read, NOW).first().pattern_count == 2
    assert pol.normalize_custom(packs.imported_patterns(read)).count() == 1


def test_meta_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], packs.PACK_SCHEMA)
    r = packs.imported_meta(df, NOW).first()
    assert (r["name"], r.description, r.pattern_count) == ("Imported pack", "Imported rule pack.", 0)


def test_export_reads_back(spark):
    custom = pol.normalize_custom(packs.imported_patterns(packs.starter_pack(spark)))
    exported = packs.export_packs(custom)
    assert len(json.loads(exported.first().pack_json)["patterns"]) == 3
    again = packs.imported_patterns(packs.parse_packs(exported, "pack_json"))
    fields = ("label", "pattern", "flags", "category", "explanation", "placeholder")
    assert sorted(map(tuple, again.select(*fields).collect())) == sorted(map(tuple, custom.select(*fields).collect()))
    assert packs.export_patterns(custom).count() == 3
    many = custom.crossJoin(spark.range(700)).drop("id").withColumn("id", F.monotonically_increasing_id().cast("string"))
    assert len(json.loads(packs.export_packs(many).first().pack_json)["patterns"]) == 2100


def test_packs_are_taken_apart_once_by_many_tasks(spark):
    df = spark.createDataFrame([(n, json.dumps(PACK)) for n in range(40)], "k int, pack string").coalesce(1)
    patterns = packs.imported_patterns(packs.parse_packs(df, "pack"), ("k",))
    assert patterns.count() == 80
    text = patterns._jdf.queryExecution().executedPlan().toString()
    assert text.count("parseJson") == 1 and text.index("parseJson") < text.index("Exchange hashpartitioning(k#")


def test_json_of_every_kind(spark):
    rows = ["[1, {}]", "[]", '{"a": [2]}', "{}", "null", "5", '"[1]"', '"{}"', "true", "not json", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(typed.parsed(F.col("j")).alias("v"))
    got = df.select(
        typed.items(F.col("v")).isNotNull().alias("array"), typed.items(F.col("v"), "a").isNotNull().alias("of_a"),
        typed.is_object(F.col("v")).alias("object"),
    ).collect()
    places = {name: [n for n, r in enumerate(got) if r[name]] for name in ("array", "of_a", "object")}
    assert places == {"array": [0, 1], "of_a": [2], "object": [2, 3]}


def test_starter_pack_finds_its_tokens(spark, scan_all):
    h = md5(b"1").hexdigest()
    policy = Policy(custom_patterns=pol.normalize_custom(packs.imported_patterns(packs.starter_pack(spark))))
    texts = ["demo_" + h, "sbx_" + h, "Jo@ExampleCorp.Internal"]
    found = scan_all(texts, policy)
    # On an internal address the built-in rule starts out with more confidence.
    assert [f[0].label for f in found] == ["Demo service token", "Sandbox access token", "Email address"]
    assert found[0][0].confidence == 86
    (internal,) = scan_all(texts[2:], Policy(detect_pii=False, custom_patterns=policy.custom_patterns))
    assert (internal[0].label, internal[0].placeholder) == ("Internal customer email", "<INTERNAL_EMAIL>")


# --- attachments -------------------------------------------------------------


@pytest.mark.parametrize(
    "name, kind, expected",
    [
        ("a.txt", None, True), ("A.JSON", "", True), (".env", None, True), ("x.png", "text/html", True),
        ("x.png", "image/png", False), ("txt", None, False), ("a.yml", "application/x", True), ("x.csv.gz", None, False),
    ],
)
def test_gate(spark, name, kind, expected):
    df = spark.createDataFrame([(name, kind)], "n string, k string")
    assert df.select(att.is_text_like(F.col("n"), F.col("k"))).first()[0] is expected


def test_scan_files(spark):
    rows = [
        file(name="a.txt", text="mail someone@example.com", size=24),
        file(name="b.txt", text="nothing"),
        file(name="c.txt", text=" \n"),
        file(name="d.log", text="x" * 249_990 + "\npassword=abc\ne@f.co"),
        file(name="e.log", text="a@b.co\n" + "x" * 250_000 + "\npassword=abc"),
    ]
    cut = att.scan_files(spark.createDataFrame(rows, FILES), max_chars=250_000)
    got = {r.file_name: r for r in cut.collect()}
    assert set(got) == {"a.txt", "e.log"}
    (f,) = got["a.txt"].findings
    assert f.match_preview == "someon....com" and not hasattr(f, "match") and not hasattr(f, "start_pos")
    assert got["a.txt"].file_key == f"i:2024-01-15 00:00:00:a.txt:24:{int(NOW.timestamp() * 1000)}"
    assert got["a.txt"].file_type == "text/plain"
    assert [x.rule_id for x in got["e.log"].findings] == ["email"]
    whole = att.scan_files(spark.createDataFrame(rows, FILES)).filter("file_name = 'e.log'").first()
    assert [x.rule_id for x in whole.findings] == ["email", "kv-secret-value"]


def test_last_selection_wins(spark):
    rows = [
        file("one", 0, "a.txt", text="a@b.co"), file("one", 1, "b.txt", text="c@d.co"), file("one", 1, "c.txt", text="e@f.co"),
        file("two", 0, "a.txt", text="a@b.co"), file("two", 2, "b.txt", text="clean"),
    ]
    df = spark.createDataFrame(rows, FILES)
    latest = att.latest_selection(att.scan_files(df), df)
    assert sorted((r.input_id, r.file_name) for r in latest.collect()) == [("one", "b.txt"), ("one", "c.txt")]


def test_batch_totals_with_one_hot_batch(spark):
    rows = [file("hot", 0, f"f{n:03}.txt", text="a@b.co\npassword=x" if n else "415 555 0042\nq@r.co") for n in range(300)]
    rows.append(file("cold", 0, "z.txt", text="a@b.co"))
    got = {r.input_id: r for r in att.batch_totals(att.scan_files(spark.createDataFrame(rows, FILES))).collect()}
    hot = got["hot"]
    assert (hot.total_findings, hot.secrets, hot.pii) == (600, 299, 301)
    assert hot.rule_labels == ["Phone number", "Email address", "Structured secret value"]
    assert got["cold"].rule_labels == ["Email address"]


def test_pending_after(spark):
    rows = [file(name="a.txt", text="a@b.co\npassword=x"), file(name="b.txt", text="c@d.co")]
    scanned = att.scan_files(spark.createDataFrame(rows, FILES))
    allowed = scanned.select(F.inline("findings")).filter("rule_id = 'email'")
    (left,) = att.pending_after(scanned, allowed).collect()
    assert (left.file_name, left.pending, left.secrets, left.pii) == ("a.txt", 1, 1, 0)


# --- incident log ------------------------------------------------------------


def log(spark, *rows):
    full = [
        (f"id{n}", ts, "claude.ai", "Claude", "masked", s + p, s, p, labels, "send", "none", None)
        for n, (ts, s, p, labels) in enumerate(rows)
    ]
    return spark.createDataFrame(full, inc.LOG_SCHEMA)


def test_event_counts_and_entries(spark):
    composer = detect.scan(
        spark.createDataFrame([(1, "a@b.co\npassword=x"), (2, "clean"), (3, "clean")], "event_id int, text string")
    )
    rows = [(1, "b.txt", None, 1, at(), "AC" + "0" * 32), (1, "a.txt", None, 1, at(), "415 555 0042"), (3, "c.txt", None, 1, at(), "c@d.co")]
    attached = att.scan_files(
        spark.createDataFrame(rows, "event_id int, file_name string, file_type string, size bigint, mtime timestamp, text string"),
        scope=("event_id",),
    )
    counts = inc.event_counts(composer, attached, "event_id")
    events = counts.withColumns(
        {"hostname": F.lit("claude.ai"), "ts": F.lit(NOW), "action": F.lit("masked"), "trigger": F.lit("send"), "mode": F.lit(None).cast("string")}
    )
    got = {r.total_findings: r for r in inc.log_entries(events, "event_id").collect()}
    assert set(got) == {4, 1}
    assert (got[4].secrets, got[4].pii, got[4].site_label, got[4].mode) == (2, 2, "Claude", "none")
    assert got[4].rule_labels == ["Email address", "Structured secret value", "Phone number", "Twilio Account SID"]
    assert got[4].note == inc.REWRITE_NOTE_FILES
    review = {r.event_id: (r.secrets, r.pii, r.total) for r in inc.review_counters("event_id", composer, attached).collect()}
    assert review == {1: (2, 2, 4), 2: (0, 0, 0), 3: (0, 1, 1)}


def test_analytics(spark):
    entries = log(
        spark,
        (at(days=-1), 1, 0, ["B", "A"]),
        (at(days=-7), 1, 3, ["A", "B"]),
        (at(days=-7, seconds=-1), 0, 0, ["C"]),
    )
    assert inc.count_last_days(entries, 7, NOW).first()[0] == 2
    assert inc.top_rule(entries).first()[0] == "B"  # level with A, but first in the newest entry
    assert inc.top_category(entries).first()[0] == "PII"
    assert [r.id for r in inc.recent(entries, 2).collect()] == ["id0", "id1"]
    empty = entries.limit(0)
    assert inc.top_rule(empty).first()[0] == inc.top_category(empty).first()[0] == "None yet"
    assert inc.count_last_days(empty, 7, NOW).first()[0] == 0
    level = log(spark, (at(), 2, 2, []))
    assert inc.top_category(level).first()[0] == "Secrets"


def test_retention(spark):
    entries = log(spark, *[(at(minutes=n), 0, 1, ["A"]) for n in range(200)])
    kept = {r.id for r in inc.retain(entries).collect()}
    assert kept == {f"id{n}" for n in range(50, 200)}


def test_log_on_disk(spark, tmp_path):
    path = str(tmp_path / "log")
    entries = log(spark, (at(), 1, 0, ["A"]), (at(days=-1), 0, 1, ["B"]))
    logs.append_log(entries, path)
    logs.append_log(entries.withColumn("id", F.concat(F.lit("x"), "id")), path)
    back = logs.read_log(spark, path)
    assert back.count() == 4 and back.filter("day = '2024-01-14'").count() == 2
    logs.clear_log(spark, path)
    assert logs.read_log(spark, path).count() == 0


def stored_ids(spark, path):
    return sorted((r.id, str(r.day)) for r in logs.read_log(spark, path).collect())


def sums(spark, path):
    found = logs.read_rollup(spark, path, logs.LABEL_FILES).groupBy("day", "label").agg(F.sum("entries").alias("n"))
    return sorted((str(r.day), r.label, r.n) for r in found.collect())


def test_a_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "log")
    entries = log(spark, *[(at(days=-(n % 3)), n % 2, 1, ["A", "B"][: 1 + n % 2]) for n in range(12)])
    logs.append_log(entries.unionByName(entries), path, "one")
    once, counted = stored_ids(spark, path), sums(spark, path)
    assert len(once) == 12
    logs.append_log(entries, path, "one")
    logs.append_log(entries, path, "another name")
    logs.append_log(entries.limit(5), path)
    assert (stored_ids(spark, path), sums(spark, path)) == (once, counted)
    # Cut short after some entries were stored, and before the sums were.
    more = entries.withColumn("id", F.concat(F.lit("x"), "id"))
    logs.append_log(more.filter("id < 'xid3'"), path, "two")
    logs._delete(spark, logs._commit(path, "two"))
    logs._delete(spark, f"{path}/{logs.LABEL_FILES}/{logs.hashlib.sha256(b'two').hexdigest()}")
    logs.append_log(more, path, "two")
    assert len(stored_ids(spark, path)) == 24
    assert sums(spark, path) == [(day, label, 2 * n) for day, label, n in counted]


def test_sums_by_label_leave_the_log_where_it_is(spark):
    entries = log(spark, *[(at(days=-(n % 3)), n % 2, 1, ["A", "B"]) for n in range(12)]).withColumn("day", F.to_date("ts"))
    found = inc.label_sums(entries)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert sorted((r.label, r.entries, r.id, r.pos) for r in found.collect()) == [
        (label, 4, f"id{n}", pos) for pos, label in enumerate("AB") for n in (0, 1, 11)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_sums_of_batches_are_those_of_the_log(spark, tmp_path, seed):
    draw = random.Random(seed)
    path = str(tmp_path / "log")
    rows = [(at(days=-draw.randint(0, 4), hours=-draw.randint(0, 2)), draw.randint(0, 2), draw.randint(0, 2), draw.sample("ABCDE", draw.randint(0, 3))) for _ in range(40)]
    entries = log(spark, *rows)
    for n in range(4):
        logs.append_log(entries.filter(F.crc32(F.col("id").cast("binary")) % 4 <= n), path, f"b{n}")
    whole = logs.read_log(spark, path)
    assert whole.count() == 40
    for since in ("2024-01-01", "2024-01-12", "2024-01-14", "2024-02-01"):
        some = whole.filter(F.col("day") >= since)
        rolled, days = (logs.read_rollup(spark, path, name).filter(F.col("day") >= since) for name in (logs.LABEL_FILES, logs.DAY_FILES))
        assert inc.top_label(rolled).first() == inc.top_rule(some).first()
        assert inc.top_category(days).first() == inc.top_category(some).first()
        assert days.agg(F.coalesce(F.sum("incidents"), F.lit(0))).first()[0] == some.count()
    logs.clear_log(spark, path)
    assert logs.read_rollup(spark, path, logs.DAY_FILES).count() == logs.read_log(spark, path).count() == 0


@pytest.mark.parametrize("n", [1, 7, 20, 21, 60, 100])
def test_retention_drops_whole_days(spark, tmp_path, n):
    path = str(tmp_path / "log")
    entries = log(spark, *[(at(days=-(k % 6), minutes=k), k % 2, 1, ["A"]) for k in range(60)])
    logs.append_log(entries, path, "all")
    expected = sorted(r.id for r in inc.retain(entries, n).collect())
    assert sorted(r.id for r in logs.retain_log(spark, path, n).collect()) == expected
    assert [i for i, _ in stored_ids(spark, path)] == expected
    days = [f.name for f in (tmp_path / "log" / logs.ENTRY_FILES).iterdir() if f.name.startswith("day=")]
    assert len(days) == min(6, -(-n // 10))
    assert sum(k for _, _, k in sums(spark, path)) == len(expected)
    logs.append_log(entries.withColumn("id", F.concat(F.lit("y"), "id")), path, "later")
    assert len(stored_ids(spark, path)) == len(expected) + 60


def test_retention_reads_the_days_it_needs(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(log(spark, *[(at(days=-k), 1, 0, ["A"]) for k in range(9)]), path)
    recent = logs.read_log(spark, path).filter(F.col("day") >= F.lit("2024-01-14").cast("date"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_log_from_json_drops_ill_typed_entries(spark, tmp_path):
    good = dict(
        id="1", timestamp="2024-01-01T00:00:00Z", hostname="h", siteLabel="s", action="masked", totalFindings=1, secrets=1,
        pii=0, ruleLabels=["A"], trigger="send",
    )
    lines = [good, {**good, "secrets": "many"}, {**good, "id": 5}, {**good, "action": {"a": 1}}, {**good, "ruleLabels": "A"}, {k: v for k, v in good.items() if k != "action"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    read = logs.read_log_json(spark, str(tmp_path / "l.json"))
    assert [(r.site_label, r.rule_labels, r.ts) for r in read.collect()] == [("s", ["A"], datetime(2024, 1, 1))]
    logs.write_log_json(read, str(tmp_path / "again"))
    assert logs.read_log_json(spark, str(tmp_path / "again")).collect() == read.collect()


def test_last_scan(spark):
    rows = [("a", "send", 1, at(), 1), ("a", "paste", 2, at(hours=1), 2), ("b", "send", 5, at(), 3)]
    df = spark.createDataFrame(rows, "hostname string, scan_type string, total int, ts timestamp, scan_id int")
    got = {r.hostname: (r.scan_type, r.total) for r in inc.last_scan(df).collect()}
    assert got == {"a": ("paste", 2), "b": ("send", 5)}


# --- settings ----------------------------------------------------------------


def test_load_policy(spark, scan_all, tmp_path):
    stored = {
        "enabled": "no", "detectPII": False, "defaultRedactionMode": "shred", "scanOnPaste": False,
        "customPatterns": [
            {"id": "c", "label": "C", "pattern": "zz+", "category": "pii"}, {"label": "D", "pattern": "q", "category": "x"},
            "not an object", {"label": 5, "pattern": "zz", "category": "pii"}, {"label": "E", "pattern": True, "category": "pii"},
        ],
        "siteProfiles": {"claude.ai": {"strictness": "relaxed", "enabled": False}, "x.example": {"enabled": True}},
        "exactAllowRules": [
            {"hostname": "claude.ai", "ruleId": "c", "matchFingerprint": "c:zzz", "expiresAt": "2024-01-01T00:00:00Z"},
            {"hostname": "chatgpt.com", "ruleId": "c", "matchFingerprint": "c:zzz", "expiresAt": "whenever"},
            {"hostname": "x.example", "ruleId": "c", "matchFingerprint": "c:zzz"},
            {"hostname": "claude.ai", "ruleId": 7, "matchFingerprint": "c:zzz"},
        ],
        "workspaceAllowlist": [{"label": "W", "pattern": "password=demo"}, {"label": "no pattern"}],
    }
    (tmp_path / "s.json").write_text(json.dumps(stored))
    policy = settings.load_policy(spark, str(tmp_path / "s.json"), NOW)
    assert (policy.enabled, policy.detect_pii, policy.scan_on_paste, policy.default_mode) == (True, False, False, "placeholder")
    texts = [("zzz", "claude.ai"), ("zzz", "chatgpt.com"), ("pwd=abc", "claude.ai"), ("password=demo1", "chatgpt.com"), ("a@b.co", "claude.ai")]
    found = scan_all(texts, policy, as_of=NOW)
    # 72 is below the relaxed threshold of the first host.
    assert [[f.rule_id for f in fs] for fs in found] == [[], [], [], [], []]
    found = scan_all(texts, policy, as_of=NOW, strictness="balanced")
    assert [[f.rule_id for f in fs] for fs in found] == [["c"], [], ["kv-secret-value"], [], []]


def test_settings_defaults(spark):
    raw = settings.parse_settings(spark.createDataFrame([("{}",)], "j string"), "j")
    tables = settings.settings_tables(raw)
    assert all(v is True for k, v in tables.toggles.first().asDict().items() if k != "default_mode")
    assert sorted(map(tuple, tables.profiles.collect())) == sorted(map(tuple, pol.default_profiles(spark).collect()))
    assert tables.exact_allow.count() == tables.packs.count() == 0


def test_settings_of_many_users_are_taken_apart_once(spark):
    given = {"detectPII": False, "siteProfiles": {"claude.ai": {"strictness": "strict"}}, "workspaceAllowlist": [{"label": "W", "pattern": "w"}, 3]}
    df = spark.createDataFrame([(n, json.dumps(given)) for n in range(9)] + [(9, "not json"), (10, "[]")], "k int, j string").coalesce(1)
    tables = settings.settings_tables(settings.parse_settings(df, "j"), ("k",), NOW)
    for table in (tables.toggles, tables.profiles, tables.custom_patterns, tables.exact_allow, tables.workspace_allow, tables.packs):
        assert "parseJson" not in table._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in tables.toggles.filter("detect_pii").orderBy("k").collect()] == [9, 10]
    assert tables.toggles.count() == 11 and tables.profiles.count() == 44 and tables.profiles.filter("strictness = 'strict'").count() == 9
    assert tables.workspace_allow.count() == 9 and tables.exact_allow.count() == tables.packs.count() == 0


def test_allow_requests_from_findings(spark):
    df = spark.createDataFrame([(1, "a@b.co", "claude.ai", NOW)], "doc_id int, text string, hostname string, ts timestamp")
    found = detect.explode_findings(detect.scan(df), "doc_id", "hostname", "ts")
    r = pol.allow_requests(found, seq="doc_id").first()
    assert (r.label, r.rule_id, r.match_fingerprint) == ("Email address allowlisted on site", "email", "email:a@b.co")

"""The live path gives what the batch gives."""

from datetime import datetime, timedelta

import pytest
from given import TESTDATA
from pyspark.sql import functions as F

from leakscan import plans
from leakscan.operators import allow, detect
from leakscan.operators import policy as pol
from leakscan.operators import redact as red
from leakscan.operators.policy import Policy
from leakscan.plans import settings as st
from leakscan.plans import streams
from leakscan.streaming import live

QUERIES = plans.queries()
SCHEMA = "doc_id int, hostname string, origin string, text string"
ROWS = [
    (n, host, origin, f"mail user{n}@b.co\npassword=abc{n}")
    for n, (host, origin) in enumerate(
        (h, o) for h in [*pol.SITES, "x.example"] for o in ("composer", "paste", "attachment") for _ in range(4)
    )
]


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(5).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stream_equals_batch(spark, folder):
    policy = Policy(profiles=st.profiles(spark))
    texts = live.read_stream(spark, folder, "*.parquet", SCHEMA, max_files=2)
    assert texts.isStreaming
    fields = ("doc_id", "rule_id", "start_pos", "end_pos", "confidence")
    streamed = live.run_to_table(
        spark, live.scan_stream(texts, policy).select("doc_id", F.inline("findings")).select(*fields), "test"
    )
    gated = pol.guarded(spark.read.parquet(folder), policy, origin_col="origin")
    batch = detect.scan(gated, policy, host_col="hostname").select("doc_id", F.inline("findings")).select(*fields)
    attached = {n for n, _, origin, _ in ROWS if origin == "attachment"}
    # Of attached files the stream keeps no positions.
    expected = [(n, rule, *((None, None) if n in attached else at), c) for n, rule, *at, c in map(tuple, batch.collect())]
    assert sorted(map(str, map(tuple, streamed.collect()))) == sorted(map(str, expected)) and expected


def test_attached_files_are_gated_and_masked(spark):
    rows = [(1, "claude.ai", "attachment", "password=abcdefghijklm", "a.png", None), (2, "claude.ai", "attachment", "password=abcdefghijklm", "a.log", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", file_name string, file_type string")
    (r,) = live.scan_stream(df, Policy()).collect()
    (f,) = r.findings
    assert r.doc_id == 2 and f.match == f.snippet == "abcdef...jklm" and f.start_pos is f.allow_fingerprint is None


def test_origin_of_streamed_findings(spark):
    scanned = live.scan_stream(spark.createDataFrame(ROWS, SCHEMA), Policy())
    out = red.redact(scanned, "full-redact").collect()
    assert {(r.origin, f.origin) for r in out for f in r.findings} == {
        ("composer", "composer"), ("paste", "composer"), ("attachment", "attachment"),
    }
    for r in out:
        assert (r.redacted == r.text) == (r.origin == "attachment")


def test_only_new_files_are_scanned_after_a_restart(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        rows = detect.scan(live.read_stream(spark, folder, "*.parquet", SCHEMA)).select("doc_id", F.size("findings").alias("n"))
        live.write_available(rows, out, checkpoint).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == run() == len(ROWS)
    spark.createDataFrame([(999, "claude.ai", "composer", "a@b.co")], SCHEMA).write.mode("append").parquet(folder)
    assert run() == len(ROWS) + 1


def test_policy_is_read_again_for_every_batch(spark, tmp_path):
    """The allow table changes between two runs of the same stream."""
    source, allow_path, out = str(tmp_path / "in"), str(tmp_path / "allow"), str(tmp_path / "out")
    allow_schema = (
        "id string, label string, hostname string, rule_id string, match_fingerprint string, created_at string, "
        "expires_at string, pos int"
    )

    def allow(*values):
        rows = [(v, v, "claude.ai", "email", f"email:{v}", "2024-01-01", None, n) for n, v in enumerate(values)]
        spark.createDataFrame(rows, allow_schema).coalesce(1).write.mode("overwrite").parquet(allow_path)

    def load(session):
        return Policy(exact_allow=pol.normalize_exact_allow(session.read.parquet(allow_path)))

    def send(n, text):
        spark.createDataFrame([(n, "claude.ai", "composer", text)], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        texts = live.read_stream(spark, source, "*.parquet", SCHEMA)
        live.scan_with_reload(texts, load, live.write_numbered(out), str(tmp_path / "ck")).awaitTermination()
        rows = spark.read.option("basePath", out).parquet(out + "/*").select("doc_id", F.inline("findings"))
        return {(r.doc_id, r.match) for r in rows.collect()}

    allow("x@y.co")
    send(1, "a@b.co x@y.co")
    assert run() == {(1, "a@b.co")}
    allow("x@y.co", "a@b.co")
    send(2, "a@b.co c@d.co")
    assert run() == {(1, "a@b.co"), (2, "c@d.co")}


def test_pending_selections_survive_a_rerun_and_can_be_emptied(spark, tmp_path):
    def scanned(*rows):
        schema = "input_id string, batch_ts int, file_name string, text string"
        return detect.scan(spark.createDataFrame(rows, schema)).drop("text")

    def pending():
        rows = live.pending_selections(spark, str(tmp_path)).collect()
        return sorted((r.input_id, r.file_name) for r in rows)

    write = live.record_selections(str(tmp_path))
    write(scanned(("a", 1, "x.txt", "a@b.co"), ("b", 1, "y.txt", "a@b.co")), 0)
    assert pending() == [("a", "x.txt"), ("b", "y.txt")]
    for _ in range(2):
        write(scanned(("a", 2, "z.txt", "a@b.co"), ("a", 2, "w.txt", "clean")), 1)
        assert pending() == [("a", "z.txt"), ("b", "y.txt")]
    write(scanned(("a", 3, None, None), ("b", 2, "v.txt", "clean")), 2)
    assert pending() == []


def test_policy_is_loaded_once_per_version(spark):
    now, loads = ["v1"], []
    source = live.reload_when_changed(lambda _: now[0], lambda _: loads.append(now[0]) or Policy())
    assert source(spark) is source(spark)
    now[0] = "v2"
    source(spark)
    assert loads == ["v1", "v2"]


def test_allow_rules_are_joined_in_the_stream(spark, folder):
    schema = "id string, label string, hostname string, rule_id string, match_fingerprint string, created_at timestamp, expires_at timestamp, pos int"
    rows = [(f"a{n}", "x", "claude.ai", "email", f"email:user{n}@b.co", None, None, n) for n in range(2000)]
    policy = Policy(exact_allow=spark.createDataFrame(rows, schema))
    scanned = live.scan_stream(live.read_stream(spark, folder, "*.parquet", SCHEMA), policy)
    assert scanned.isStreaming
    out = live.run_to_table(spark, scanned.select("doc_id", "hostname", F.inline("findings")).select("doc_id", "hostname", "rule_id"), "allow")
    mails = {r.hostname for r in out.filter("rule_id = 'email'").collect()}
    assert mails == set(pol.SITES) - {"claude.ai"}


@pytest.mark.parametrize("carried", [4000, 1])
def test_rules_beyond_those_that_ride_along_are_joined_with_micro_batches(spark, tmp_path, monkeypatch, carried):
    """The scan of a host's texts does not carry all of its rules, however many there are; rows are the same."""
    monkeypatch.setattr(allow, "MOST_CARRIED", carried)
    most = []
    ride = allow._carried
    monkeypatch.setattr(allow, "_carried", lambda rules, keys: most.append(rules.groupBy(*keys).count().agg(F.max("count")).first()[0]) or ride(rules, keys))
    found = QUERIES["stream_allow"](spark, f"{TESTDATA}/sf0.001").collect()
    monkeypatch.undo()
    expected = QUERIES["stream_allow"](spark, f"{TESTDATA}/sf0.001").collect()
    assert sorted(map(str, found)) == sorted(map(str, expected)) and found
    # A plan that carries all is made for its columns, and not run.
    assert (most[-1] or 0) <= carried


def test_a_stream_of_no_texts_makes_an_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(allow, "MOST_CARRIED", 0)
    schema = "doc_id int, hostname string, origin string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    rules = [("claude.ai", "email", "email:a@b.co", None, None)]
    rules = spark.createDataFrame(rules, "hostname string, rule_id string, match_fingerprint string, created_at timestamp, expires_at timestamp")
    texts = live.read_stream(spark, f"{tmp_path}/in", "*.parquet", spark.createDataFrame([], schema).schema)
    out = live.scan_to_table(spark, texts, Policy(exact_allow=rules), lambda df: df.select("doc_id", F.inline("findings")), "none")
    assert out.count() == 0 and "rule_id" in out.columns


def test_versions_hold_from_their_time_to_the_next(spark):
    def row(host, on, strictness, day):
        return (host, "x", on, strictness, True, False, "placeholder", datetime(2024, 1, day))

    written = spark.createDataFrame(
        [row("claude.ai", True, "strict", 2), row("claude.ai", False, "strict", 4), row("claude.ai", True, "relaxed", 6), row("chatgpt.com", True, "balanced", 3)],
        pol.PROFILE_SCHEMA + ", since timestamp",
    )
    versions = pol.profile_versions(written)
    texts = [(d, h, o, "pwd=abc", datetime(2024, 1, d)) for d in range(1, 8) for h in ("claude.ai", "chatgpt.com", "x.example") for o in ("composer", "attachment")]
    df = spark.createDataFrame(texts, SCHEMA + ", ts timestamp")
    found = {(r.doc_id, r.hostname, r.origin, r.profile.strictness, len(r.findings)) for r in live.scan_stream(df, Policy(), versions).collect()}
    expected = {(d, "claude.ai", "composer", "strict", 1) for d in (2, 3)} | {(d, "claude.ai", "composer", "relaxed", 0) for d in (6, 7)}
    assert found == expected | {(d, "chatgpt.com", "composer", "balanced", 1) for d in range(3, 8)}
    assert live.scan_stream(df, Policy(enabled=False), versions).count() == 0


def test_compaction_keeps_what_is_pending_and_nothing_else(spark, tmp_path):
    path = str(tmp_path)
    schema = "input_id string, batch_ts timestamp, file_name string, text string"
    day = lambda n: datetime(2024, 1, n)

    def select(number, *rows):
        live.record_selections(path)(detect.scan(spark.createDataFrame(rows, schema)).drop("text"), number)

    def pending():
        return sorted((r.input_id, r.file_name) for r in live.pending_selections(spark, path).collect())

    def held(name):
        return sorted(r.input_id for r in spark.read.parquet(f"{path}/{live.SNAPSHOT}/{name}/upto={live._parts(spark, f'{path}/{live.SNAPSHOT}/{name}', 'upto=')[-1]}").collect())

    month = timedelta(days=9)
    select(0, *[(f"i{n}", day(1), "x.txt", "a@b.co") for n in range(5)], ("gone", day(1), None, None))
    assert live.compact_selections(spark, path, month) == live.compact_selections(spark, path, month) == 0
    assert pending() == [(f"i{n}", "x.txt") for n in range(5)] and held("selections") == ["gone", *[f"i{n}" for n in range(5)]]
    # A selection of no file, one of other files, and one that comes late.
    select(1, ("i0", day(3), None, None), ("i1", day(3), "y.txt", "a@b.co"), ("i2", day(3), "z.txt", "clean"))
    before = pending()
    assert before == [("i1", "y.txt"), ("i3", "x.txt"), ("i4", "x.txt")]
    # Cut short: the new snapshot has its files but is not complete.
    detect.scan(spark.createDataFrame([("i9", day(9), "q.txt", "a@b.co")], schema)).drop("text").write.parquet(f"{path}/{live.SNAPSHOT}/files/upto=1")
    assert pending() == before
    assert live.compact_selections(spark, path, month) == 1 and pending() == before
    assert live._parts(spark, f"{path}/files", "batch=") == [] and live._parts(spark, f"{path}/{live.SNAPSHOT}/files", "upto=") == [1]
    select(2, ("i0", day(2), "late.txt", "a@b.co"), ("new", day(20), "n.txt", "a@b.co"))
    assert pending() == sorted([*before, ("new", "n.txt")])
    live.compact_selections(spark, path, month)
    assert pending() == sorted([*before, ("new", "n.txt")])
    # Emptied inputs are forgotten; those with pending files are not, however old.
    assert held("selections") == ["i1", "i3", "i4", "new"] and held("files") == ["i1", "i3", "i4", "new"]


def test_keyed_table_takes_the_newest_row(spark, tmp_path):
    path = str(tmp_path / "table")
    write = live.merge_by_key(path, "hostname", F.struct("ts", "scan_id"))

    def send(number, *rows):
        write(spark.createDataFrame(rows, "hostname string, total int, ts int, scan_id int"), number)
        return sorted(tuple(r) for r in live.read_merged(spark, path).collect())

    assert send(0, ("a", 1, 5, 1), ("b", 1, 5, 1)) == [("a", 1, 5, 1), ("b", 1, 5, 1)]
    assert send(1, ("a", 2, 4, 9), ("b", 2, 5, 2)) == [("a", 1, 5, 1), ("b", 2, 5, 2)]
    assert send(1, ("a", 3, 9, 9)) == [("a", 1, 5, 1), ("b", 2, 5, 2)]
    assert send(2, ("c", 3, 1, 1)) == [("a", 1, 5, 1), ("b", 2, 5, 2), ("c", 3, 1, 1)]


@pytest.mark.parametrize("name", ["stream_pending", "stream_scan", "stream_allow", "stream_log"])
def test_a_table_may_be_a_folder_of_files(spark, tmp_path, name):
    one, many = f"{TESTDATA}/sf0.001", str(tmp_path)
    spark.read.parquet(f"{one}/documents.parquet").repartition(3).write.parquet(f"{many}/documents.parquet")
    expected = QUERIES[name](spark, one).collect()
    assert sorted(map(str, QUERIES[name](spark, many).collect())) == sorted(map(str, expected)) and expected


@pytest.fixture()
def dealt(spark, tmp_path):
    """The smallest tables, the texts in four files."""
    spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_arriving_texts_are_dealt_to_as_many_files_as_they_are_read_in(spark, dealt):
    for n, _ in enumerate(streams.in_steps(spark, dealt, f"{dealt}/steps")):
        assert live.count_files(spark, f"{dealt}/steps/in") == 4 * (n + 1)
    given = streams.for_spark(spark, dealt, "arriving")
    assert [streams.in_halves(given, f"{dealt}/halves") for _ in range(2)] == [2, 2]


def test_a_batch_of_selections_is_scanned_once(spark, tmp_path):
    scanned = spark.sparkContext.accumulator(0)

    def found(n):
        scanned.add(1)
        return [n]

    rows = spark.range(10).selectExpr("id", "'a' AS input_id", "timestamp'2024-01-01' AS batch_ts", "'f' || id AS file_name")
    batch = detect._bind(rows, F.udf(found, "array<bigint>")("id"), "findings")
    live.record_selections(f"{tmp_path}/log")(batch, 0)
    assert live.pending_selections(spark, f"{tmp_path}/log").count() == 10 and scanned.value == 10

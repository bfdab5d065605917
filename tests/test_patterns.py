"""User patterns held in tables: which are accepted, what they match, and the scan of many users."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leakscan.functions import ecmascript
from leakscan.functions import patterns as written
from leakscan.operators import detect, patterns
from leakscan.operators import policy as pol
from leakscan.operators.policy import Policy
from leakscan.sources.settings import SettingsTables

PARTS = [
    "a", "b", "1", "_", " ", "é", "-", "{", "}", "]", ".", "^", "$", r"\b", r"\B", r"\d", r"\s", r"\S", r"\w", r"\.", r"\n",
    r"\x41", r"b", r"\0", r"\v", "[a-c]", "[^b]", r"[\s\d]", "[]", "[^]", r"[a\-]", "[a&&b]", "[[b]", r"[\b]", "(?:a|b)",
    r"(?:[a-c]|\d)", r"(?:é|-|\])", "(?:a|.)", "(ab)", "(?:ab|c)", "(?=a)", "(?!b)", "(?<=a)", "(?<!ab|c)", "(?<n>a)",
    "((a)b)", "(a(b(c)))", "(a(b(c(d))))", "(", ")", "*", "+", "?", "{2}", "{1,3}", "{3,1}", "|", r"\1", "[c-a]", r"[a-\d]",
    "(?i)", "a++", r"\k<n>", r"\p{L}", "/", "#", "@", "(?<=a+)", "(a+)", "(?:)", "\\", "{9999999999}",
]
QUANTIFIERS = ["", "", "", "*", "+", "?", "{2}", "{1,2}", "{2,}", "+?", "{0,100}", "{101}", "{5,200}"]
TEXTS = ["aab b1_ c", "ABab\naé-{2}]", "x12  ab b\n", "", "aaaa bbb", "abc]-&[.\\ \x08\x0b\x00 a/b#@", "éÉ aé", "cdcdabab{1} }"]


def parsed(pattern, flags):
    try:
        return ecmascript.translate(pattern, flags)
    except ecmascript.Refused:
        return None


def test_what_a_table_accepts_matches_what_the_parser_says(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(3000):
        pattern = "".join(draw.choice(PARTS) + draw.choice(QUANTIFIERS) for _ in range(draw.randint(0, 5)))
        flags = draw.choice(["", "i", "s", "m", "u", "iu", "y", "ims"])
        rows.append((pattern, flags, parsed(pattern, flags)))
    p, f = F.col("p"), F.col("f")
    given = spark.createDataFrame(rows, "p string, f string, expected string")
    checked = given.select(
        "*", written.refusal(p, f).alias("reason"), written.java(p, f).alias("java"), written.literal(p, f).alias("start")
    ).collect()
    used = [r for r in checked if r.reason is None]
    assert [r.p for r in used if r.expected is None] == []
    assert len(used) > 0.8 * sum(r.expected is not None for r in checked)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    both = spark.createDataFrame(used, "p string, f string, expected string, reason string, java string, start string")
    found = both.join(texts).select(
        "*", *(F.regexp_replace("t", F.col(c), F.lit("<$0>")).alias(f"by_{c}") for c in ("java", "expected"))
    )
    assert found.filter("by_java <> by_expected").count() == 0
    missed = found.filter("start <> '' and by_java <> t").filter(~F.col("t").contains(F.col("start")) & ~F.lower("t").contains(F.col("start")))
    assert missed.count() == 0


def test_reasons(spark):
    rows = [
        ("a**", "", "nothing to repeat"), ("(?:*)", "", "nothing to repeat"), ("^+", "", "nothing to repeat"),
        ("(?P<a>b)", "", "invalid group"), ("x{2", "u", "incomplete quantifier"), ("x{2", "", None), ("a]", "u", "lone bracket"),
        ("(a)\\1", "", "refers to a group that may not have taken part"), ("(a", "", "unterminated group"), ("a)", "", "unmatched )"),
        ("[a", "", "unterminated class"), ("a\\", "", "\\ at the end"), ("a{3,1}", "", "numbers out of order in a quantifier"),
        ("[z-a]", "", "range out of order in a class"), ("(?<n>a)(?<n>b)", "", "repeated group name"),
        ("(?:ab|c)+", "", "repeats without bound a group that branches or varies in length"), ("(?:ab)+", "", None),
        ("(?:a|[bc])+", "", None), (r"\bdemo_[A-Za-z0-9]{18,}\b", "g", None), ("a" * 3000, "", "too long for a table"), ("", "", None),
    ]
    given = spark.createDataFrame(rows, "p string, f string, reason string")
    got = given.select("p", "reason", written.refusal(F.col("p"), F.col("f")).alias("found")).collect()
    assert [(r.p, r.found) for r in got] == [(r.p, r.reason) for r in got]


def settings(spark, own, workspace, allow, users):
    toggles = spark.createDataFrame([(u, u != 4, u != 3, u != 2) for u in users], "user int, enabled boolean, detect_secrets boolean, detect_pii boolean")
    profiles = spark.createDataFrame([(u,) for u in users], "user int").crossJoin(
        pol.default_profiles(spark).withColumn("strictness", F.lit("strict"))
    )
    none = spark.createDataFrame([], "user int, id string")
    return SettingsTables(toggles, profiles, own, allow, workspace, none)


@pytest.mark.parametrize("carried", [200, 2, 0])
def test_own_patterns_are_found_as_under_a_policy_of_each_user(spark, monkeypatch, carried):
    monkeypatch.setattr(patterns, "MOST_CARRIED", carried)
    words = ["alpha", "BETA", "gamma-7", "delta_x", "été", "x@y.co", "key=val12345"]
    draw = random.Random(2)
    schema = "user int, id string, label string, pattern string, flags string, category string, enabled boolean, explanation string, placeholder string, pos int"
    rows = []
    for n in range(60):
        user = draw.choice([1, 1, 2, 3, 5])
        word = draw.choice(words)
        pattern = draw.choice([word.replace(".", r"\."), r"\b" + word[:4], word[:3] + "[a-z]*", "(?:" + word + "|q)", "[aeiou]{2,}", "(broken"])
        rows.append((user, f"p{n}", f" Label {n}! ", pattern, draw.choice(["g", "gi", "", "gm"]), draw.choice(["secret", "pii"]),
                     n % 9 != 0, draw.choice([None, "why", " "]), draw.choice([None, "<OWN>", ""]), n))
    own = pol.normalize_custom(spark.createDataFrame(rows, schema), ("user",))
    lines = [(1, "w", "w", "^skip", "gm", True, 0), (2, "v", "v", "BETA$", "", True, 1), (2, "b", "b", "(", "", True, 2)]
    workspace = pol.normalize_workspace(
        spark.createDataFrame(lines, "user int, id string, label string, pattern string, flags string, enabled boolean, pos int"), ("user",)
    )
    allowed = [(1, "a", "a", "claude.ai", "p1", "p1:" + words[0], None, None, 0), (1, "b", "b", "claude.ai", "email", "email:x@y.co", None, None, 1)]
    allow = spark.createDataFrame(allowed, "user int, id string, label string, hostname string, rule_id string, match_fingerprint string, created_at timestamp, expires_at timestamp, pos int")
    users = [1, 2, 3, 4, 5]
    texts = []
    for k in range(50):
        body = "\n".join(("skip " if draw.random() < 0.2 else "") + " ".join(draw.choices(words, k=4)) for _ in range(3))
        texts.append((k, draw.choice(users + [9]), "claude.ai", draw.choice([body, "", None]) if k % 7 == 0 else body))
    df = spark.createDataFrame(texts, "doc_id int, user int, hostname string, text string")
    tables = settings(spark, own, workspace, allow, users)
    found = {r.doc_id: r.findings for r in detect.scan_by_user(df, tables, ("user",)).collect()}
    expected = {}
    for user in users:
        if user == 4:
            continue
        policy = Policy(
            detect_secrets=user != 3, detect_pii=user != 2,
            custom_patterns=own.filter(F.col("user") == user).orderBy("pos"), workspace_allow=workspace.filter(F.col("user") == user),
            exact_allow=allow.filter(F.col("user") == user),
        )
        scanned = detect.scan(df.filter(F.col("user") == user), policy, host_col="hostname", strictness="strict")
        expected |= {r.doc_id: r.findings for r in scanned.collect()}

    def plain(findings):
        # Rules are numbered among those of a policy, and among all of the built-in ones.
        return [[v for k, v in f.asDict().items() if k != "rule_ord"] for f in findings]

    assert set(found) == set(expected)
    assert {k: plain(v) for k, v in found.items()} == {k: plain(v) for k, v in expected.items()}
    assert sum(f.source == "custom" for v in found.values() for f in v) > 50


def test_busy_users_patterns_are_looked_up_by_more_than_a_few_letters(spark):
    """Patterns that find the same are one, unless an allow rule names them; a literal is looked up by its first eight letters."""
    rows = [(1, f"p{n}", "L", p, "g", "pii", True, None, None, n) for n, p in enumerate(["password", "passive-one", "passive-two", "password", "[0-9]{9,}", "password"])]
    schema = "user int, id string, label string, pattern string, flags string, category string, enabled boolean, explanation string, placeholder string, pos int"
    own = pol.normalize_custom(spark.createDataFrame(rows, schema), ("user",))
    allow = spark.createDataFrame([(1, "p5")], "user int, rule_id string")
    busy = patterns.once_each(patterns.as_rules(own, ("user",)), ["user"], allow)
    assert sorted(r.rule.id for r in busy.collect()) == ["p0", "p1", "p2", "p4", "p5"]
    texts = spark.createDataFrame([(1, "The PASSWORDS and xpassword"), (1, "passi"), (1, "x passive-o"), (1, None)], "user int, text string")
    found = patterns.looked_up(texts.withColumn(patterns.OWN, F.lit(None)), busy, ("user",)).collect()
    kept = {r.text: [p.id for p in r[patterns.OWN]] for r in found}
    assert kept == {"The PASSWORDS and xpassword": ["p0", "p4", "p5"], "passi": ["p4"], "x passive-o": ["p1", "p2", "p4"], None: ["p4"]}


def test_literals_are_found_anywhere_in_words_of_any_length(spark):
    long = "".join(random.Random(3).choices("abcdefghij0123456789_", k=1000))
    texts = [long + " Été-Passive-one x", "ab", "", "abc"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(patterns.grams(F.col("t"))).collect()
    for text, (found,) in zip(texts, got):
        low = text.lower()
        runs = [w for w in re.split("[^A-Za-z0-9_@:/=-]+", low) if w]
        assert {w[i:i + k] for w in runs for k in patterns.GRAMS for i in range(len(w) - k + 1)} <= set(found)
        assert all(x in low for x in found)


def test_what_matches_start_with_and_whether_they_stay_on_a_line(spark):
    rows = [
        ("abc[0-9]", "", ["abc"], True), ("(?:one|@e)x", "", ["onex", "@ex"], True), ("(one|two)", "i", ["one", "two"], True),
        ("(?:One|two)-x*", "gi", ["one-", "two-"], True), ("(?:one|two)?x", "", [], True), ("(?:one|two)|x", "", [], True),
        ("(?:one|t)", "", [], True), ("(?:one|t.)", "", [], True), ("(?:one|t.)", "s", [], False), ("abc$", "", ["abc"], False),
        ("abc$", "m", ["abc"], True), ("abc[^d]", "", ["abc"], False), (r"abc\s", "", ["abc"], False), (r"abc\W", "", ["abc"], False),
        (r"abc[\s\d]", "", ["abc"], False), (r"abc[\d.-]+\b", "", ["abc"], True), ("abc(?=d)", "", ["abc"], False), ("abc\n", "", ["abc"], False),
        ("abc.", "s", ["abc"], False), ("abc.", "y", ["abc"], False), (r"abc\x0a", "", ["abc"], False), ("abc[\t-z]", "", ["abc"], False),
    ]
    given = spark.createDataFrame([r[:2] for r in rows], "p string, f string")
    got = given.select("p", "f", written.starts(F.col("p"), F.col("f")), written.on_a_line(F.col("p"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == rows


def test_rules_that_find_what_an_earlier_one_finds_are_left_out_of_a_text(spark):
    """What goes on with a text of a busy user is what it finds there, not every pattern that might."""
    given = [("(?:alpha|@e)x", "pii"), ("(?:beta|@e)x", "pii"), ("(?:gamma|@e)x", "secret"), ("[xyz]{5,}", "pii"), ("(?:beta|@e)x", "pii"),
             ("[0-9]{3}$", "pii"), ("[0-9]{3}", "pii"), ("delta", "pii"), ("(?:del|@e)", "pii")]
    rows = [(1, f"p{n}", "L", p, "gm", kind, True, None, None, n) for n, (p, kind) in enumerate(given)]
    schema = "user int, id string, label string, pattern string, flags string, category string, enabled boolean, explanation string, placeholder string, pos int"
    own = pol.normalize_custom(spark.createDataFrame(rows, schema), ("user",))
    allow = spark.createDataFrame([(1, "p4")], "user int, rule_id string")
    busy = patterns.once_each(patterns.as_rules(own, ("user",)), ["user"], allow)
    texts = spark.createDataFrame([(1, "a@ex\n123 4"), (1, "betax a@ex\n123"), (1, "delta @f"), (1, None)], "user int, text string")
    found = patterns.looked_up(texts.withColumn(patterns.OWN, F.lit(None)), busy, ("user",), tried=True).collect()
    kept = {r.text: [p.id for p in r[patterns.OWN]] for r in found}
    assert kept == {
        "a@ex\n123 4": ["p0", "p2", "p4", "p6", "p8"], "betax a@ex\n123": ["p0", "p1", "p2", "p4", "p5", "p8"],
        "delta @f": ["p7", "p8"], None: [],
    }

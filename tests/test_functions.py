"""String, regex and array column functions."""

import random

import pytest
from pyspark.sql import functions as F

from leakscan.functions import arrays, ecmascript, regex
from leakscan.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def found(spark, pattern, flags, text):
    return value(spark, F.lit(text).rlike(regex.to_java(pattern, flags)))


@pytest.mark.parametrize(
    "pattern, flags, text, expected",
    [
        (r"\bAKIA", "", "\u00e9AKIA", True),  # the boundary knows ASCII words only
        (r"\bAKIA", "", "xAKIA", False),
        (r"1\b", "", "1\u00e9", True),
        (r"a\Bb", "", "ab", True),
        (r"\sx", "", "\u00a0x", True),
        (r"[\s]x", "", "\ufeffx", True),
        (r"\S", "", "\u3000\u00a0", False),
        (r"^b", "m", "a\rb", True),
        (r"^b", "m", "a\u0085b", False),
        (r"^b", "m", "a\u2028b", True),
        (r"^b", "", "a\nb", False),
        (r"a$", "", "a\n", False),
        (r"a$", "m", "a\nb", True),
        (r"a.b", "", "a\u0085b", True),
        (r"a.b", "", "a\rb", False),
        (r"a.b", "s", "a\nb", True),
        (r"a[^]b", "", "a\nb", True),
        (r"a[]b", "", "ab", False),
        (r"x{y", "", "x{y", True),
        (r"[[a]", "", "[", True),
        (r"[a&&b]", "", "&", True),
        (r"\u0041", "", "A", True),
        (r"\u{41}", "u", "A", True),
        (r"\/\-", "", "/-", True),
        (r"\v", "", "\n", False),
        (r"\Q.\E", "", "QxE", True),
        (r"(\w)\1{3}", "", "aaaa", True),
        ("\u00e9", "i", "\u00c9", True),
        (r"abc", "i", "ABC", True),
    ],
)
def test_ecmascript_meaning_is_kept(spark, pattern, flags, text, expected):
    assert found(spark, pattern, flags, text) is expected


def test_line_start_positions_in_crlf(spark):
    marked = F.regexp_replace(F.lit("a\r\nb\n"), regex.to_java("^", "m"), "|")
    assert value(spark, marked) == "|a\r|\n|b\n|"


REFUSED = {
    "a++": "nothing to repeat", "(?i)abc": "invalid group", "(?>ab)c": "invalid group", "(": "unterminated group",
    ")": "unmatched )", "[b-a]": "range out of order in a class", "[a": "unterminated class", "a{3,1}": "numbers out of order in a quantifier",
    "^*": "nothing to repeat", "(?<=a)*": "nothing to repeat", "\\": "\\ at the end", "(?<a>x)(?<a>y)": "repeated group name",
    r"^(?:(a)|b)\1$": "refers to a group that may not have taken part", r"(a)?\1": "refers to a group that may not have taken part",
    "(?:que|aux){2,}": "repeats without bound a group that branches or varies in length",
    r"(?:\w+\.)+x": "repeats without bound a group that branches or varies in length",
}


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused_patterns_say_why(pattern):
    assert ecmascript.reason(pattern) == REFUSED[pattern]


@pytest.mark.parametrize("pattern, flags", [("x{2", "u"), ("]", "u"), (r"\-", "u"), (r"\1", "u"), (r"[\d-z]", "u")])
def test_some_patterns_are_refused_with_a_flag_only(pattern, flags):
    assert ecmascript.reason(pattern) is None and ecmascript.reason(pattern, flags)


@pytest.mark.parametrize(
    "pattern, flags, text, expected",
    [
        (r"(?<my_name>x+)-\k<my_name>$", "", "xx-xx", True), (r"^(?<my_name>x+)-\k<my_name>$", "", "xx-x", False),
        (r"(a)\1+$", "", "aaaa", True), (r"^\1(a)$", "", "a", True), (r"^(?:[A-F]|\d)+$", "", "A1B2", True),
        (r"^(?:[^a]|b)*$", "", "bcd", True), (r"^(?:[^a]|b)*$", "", "bad", False), (r"^(?:.|\n)*$", "", "a\nb", True),
        (r"^(?:-|\^|&)+$", "", "-^&", True), (r"^(?:-|\^|&)+$", "", "-a", False), (r"^\p{Letter}+$", "u", "é", True),
        (r"^\x41\u0042\103$", "", "ABC", True), (r"^x{y$", "", "x{y", True), (r"^(?=a)*b$", "", "b", True),
        (r"^(?:ab){2,}$", "", "ab" * 5000, True), (r"\bfoo\b", "i", "a FOO.", True),
    ],
)
def test_checked_patterns_match_as_meant(spark, pattern, flags, text, expected):
    assert value(spark, F.lit(text).rlike(ecmascript.translate(pattern, flags))) is expected


def test_a_long_run_does_not_exhaust_the_stack(spark):
    java = ecmascript.translate(r"(?:[A-F]|\d)+", "g")
    marked = F.regexp_replace(F.repeat(F.lit("A1"), 100_000), java, "")
    assert value(spark, F.length(marked)) == 0


def test_split_capture():
    assert regex.split_capture(r"\b(?:a|b)\([)](x+(?:y)?)z") == (r"\b(?:a|b)\([)]", "x+(?:y)?", "z")
    with pytest.raises(ValueError):
        regex.split_capture("(?:a)")


@pytest.mark.parametrize(
    "pattern, prefix",
    [(r"\bdemo_[a-z]+", "demo_"), ("ab+", "a"), ("abc?", "ab"), ("ab|cd", ""), (r"(x)", ""), ("abc", "abc"), ("ab{2}", "a")],
)
def test_literal_prefix(pattern, prefix):
    assert regex.literal_prefix(pattern) == prefix


@pytest.mark.parametrize(
    "text, masked",
    [
        ("a", "a***"), ("abcdef", "a***"), ("abcdefg", "abcd****fg"), ("abcdefghij", "abcd****ij"),
        ("a" * 20, "aaaa" + "*" * 14 + "aa"), ("  ab \n c ", "a***"), ("", "***"),
    ],
)
def test_partial_mask(spark, text, masked):
    assert value(spark, tx.partial_mask(F.lit(text))) == masked


@pytest.mark.parametrize(
    "text, preview", [("abcdefghij", "ab..."), ("abcdefghijk", "abcdef...hijk"), (" a\t b ", "a ...")]
)
def test_mask_snippet(spark, text, preview):
    assert value(spark, tx.mask_snippet(F.lit(text))) == preview


def test_white_space(spark):
    assert value(spark, tx.ws_trim(F.lit("\ufeff\u2003 a \u00a0b\u3000\n"))) == "a \u00a0b"
    assert value(spark, tx.ws_collapse(F.lit(" a\u00a0\n b "))) == "a b"
    assert value(spark, tx.is_blank(F.lit("\u00a0\t\n"))) is True
    assert value(spark, tx.nbsp_to_space(F.lit("a\u00a0b"))) == "a b"


@pytest.mark.parametrize(
    "label, placeholder",
    [("Demo token", "<DEMO_TOKEN>"), ("--", "<REDACTED>"), ("  a-b  ", "<A_B>"), ("\u00e9t\u00e9 1", "<T_1>")],
)
def test_placeholder_from_label(spark, label, placeholder):
    from leakscan.operators.rules import default_placeholder

    assert value(spark, tx.placeholder_from_label(F.lit(label))) == placeholder
    assert default_placeholder(label) == placeholder


@pytest.mark.parametrize("flags, kept", [("ggi", "gi"), ("xyz", "y"), ("", ""), ("msmdu", "msdu")])
def test_flags(spark, flags, kept):
    assert value(spark, tx.sanitize_flags(F.lit(flags))) == kept
    assert regex.sanitize_flags(flags) == kept


def test_escape_html(spark):
    assert value(spark, tx.escape_html(F.lit("<a b=\"c\">&'"))) == "&lt;a b=&quot;c&quot;&gt;&amp;&#039;"


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_fold_emit_keeps_state_across_blocks(spark, n):
    items = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")

    def step(total, x):
        new = total + x
        return F.struct(new.alias("state"), F.when(x % 3 == 0, new).alias("emit"))

    got = value(spark, arrays.fold_emit(items, F.lit(0), step, "int"))
    sums = [sum(range(i + 1)) for i in range(n + 1)]
    assert got["state"] == sums[n]
    assert got["out"] == [sums[i] for i in range(1, n + 1) if i % 3 == 0]


def test_between_blocks(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("ab\u00e9\n\u4e2d") for _ in range(100))
    pairs = [tuple(sorted((rng.randint(0, 100), rng.randint(0, 100)))) for _ in range(60)] + [(0, 100), (100, 100), (0, 0)]
    df = spark.createDataFrame([(text, a, b) for a, b in pairs], "t string, a int, b int")
    got = df.select(
        "a", "b", tx.let(arrays.cut_blocks(F.col("t"), 16), lambda x: arrays.between(x, F.col("a"), F.col("b"), 16)).alias("v")
    ).collect()
    for r in got:
        assert r["v"] == text[r["a"] : r["b"]], (r["a"], r["b"])

"""Rewriting and reports."""

import random

import pytest
from pyspark.sql import functions as F

from leakscan.operators import detect
from leakscan.operators import policy as pol
from leakscan.operators import redact as red
from leakscan.operators.policy import Policy

TEXT = 'mail <a@b.co> & "x"\npassword=abcdefgh; call 415 555 0042'


def rewritten(spark, texts, mode, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = red.redact(detect.scan(df, **options), mode).orderBy("doc_id").collect()
    return [r.redacted for r in rows]


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("placeholder", 'mail <<EMAIL_ADDRESS>> & "x"\npassword=<SECRET_VALUE>; call <PHONE_NUMBER>'),
        ("partial-mask", 'mail <a***> & "x"\npassword=abcd****gh; call 415 ******42'),
        ("full-redact", 'mail <[REDACTED]> & "x"\npassword=[REDACTED]; call [REDACTED]'),
    ],
)
def test_modes(spark, mode, expected):
    assert rewritten(spark, [TEXT, "nothing here", ""], mode) == [expected, "nothing here", ""]


def test_attachments_are_never_rewritten(spark):
    assert rewritten(spark, [TEXT], "placeholder", origin="attachment") == [TEXT]


def test_redacted_text_holds_no_match(spark):
    (out,) = rewritten(spark, [TEXT], "full-redact")
    assert rewritten(spark, [out], "full-redact") == [out]


def test_reports(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "a<b")], "doc_id int, text string")
    scanned = detect.scan(df).select(
        "doc_id",
        red.highlighted(F.col("text"), F.col("findings")).alias("h"),
        red.replacement_preview(F.col("text"), F.col("findings"), F.lit("placeholder")).alias("p"),
    )
    one, two = scanned.orderBy("doc_id").collect()
    assert one.h.startswith('mail &lt;<mark class="found found--pii">a@b.co</mark>&gt; &amp; &quot;x&quot;\n')
    assert '<mark class="found found--replacement">&lt;EMAIL_ADDRESS&gt;</mark>' in one.p
    assert two.h == two.p == "a&lt;b"


def test_mode_by_profile(spark):
    rows = [("claude.ai", "C", True, "balanced", True, True, "full-redact")]
    policy = Policy(profiles=spark.createDataFrame(rows, pol.PROFILE_SCHEMA), default_mode="partial-mask")
    df = spark.createDataFrame(
        [(1, "a@b.co", "claude.ai"), (2, "long.name@b.co", "elsewhere.example")],
        "doc_id int, text string, hostname string",
    )
    scanned = detect.scan(pol.with_mode(df, policy), policy, host_col="hostname")
    out = red.redact(scanned, F.col("mode")).orderBy("doc_id").collect()
    assert [r.redacted for r in out] == ["[REDACTED]", "long********co"]


def test_long_texts_against_python(spark):
    rng = random.Random(5)
    texts = []
    for n in (3, 200, 4000):
        words = [rng.choice(["user%d@example.com" % i, "filler" * rng.randint(1, 9), "\u00e9t\u00e9"]) for i in range(n)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in red.redact(detect.scan(df), "placeholder").collect():
        expected, cursor = "", 0
        for f in r.findings:
            expected += r.text[cursor : f.start_pos] + f.placeholder
            cursor = f.end_pos
        assert r.redacted == expected + r.text[cursor:]

"""String column functions: trimming, masking, fingerprints, markup.

Everything here is a composition of built-in Spark functions, so it stays in
the JVM.  Lengths and offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript treats as white space.
JS_SPACES = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the body of a Java character class.
JS_SPACE_CLASS = (
    r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

FULL_REDACTION = "[REDACTED]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def ws_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(JS_SPACES))


def is_blank(value: Column) -> Column:
    return F.length(ws_trim(value)) == 0


def ws_collapse(value: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.btrim(F.regexp_replace(value, f"[{JS_SPACE_CLASS}]+", " "), F.lit(" "))


def nbsp_to_space(value: Column) -> Column:
    return F.replace(value, F.lit("\u00a0"), F.lit(" "))


def head(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def partial_mask(value: Column) -> Column:
    """Keep the first four and last two characters, star out the rest."""
    def mask(c: Column) -> Column:
        n = F.length(c)
        return F.when(n <= 6, F.concat(head(c, 1), F.lit("***"))).otherwise(
            F.concat(
                head(c, 4),
                F.repeat(F.lit("*"), F.greatest(F.lit(4), n - 6)),
                F.right(c, F.lit(2)),
            )
        )

    return let(ws_collapse(value), mask)


def mask_snippet(value: Column) -> Column:
    """Short preview of a match that does not give the match away."""
    def mask(c: Column) -> Column:
        return F.when(F.length(c) <= 10, F.concat(head(c, 2), F.lit("..."))).otherwise(
            F.concat(head(c, 6), F.lit("..."), F.right(c, F.lit(4)))
        )

    return let(ws_collapse(value), mask)


def allow_fingerprint(rule_id: Column, match: Column) -> Column:
    return F.concat(rule_id, F.lit(":"), ws_collapse(match))


def escape_html(value: Column) -> Column:
    # Fixed values; the ampersand has to go first.
    for raw, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#039;"),
    ):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def placeholder_from_label(label: Column) -> Column:
    """``Demo token`` becomes ``<DEMO_TOKEN>``; nothing usable, ``<REDACTED>``."""
    name = F.btrim(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.concat(
        F.lit("<"), F.coalesce(F.nullif(name, F.lit("")), F.lit("REDACTED")), F.lit(">")
    )


def sanitize_flags(flags: Column) -> Column:
    """Keep known regex flags, once each, in the order they first appear."""
    kept = F.regexp_replace(flags, "[^dgimsuy]", "")
    return F.array_join(F.array_distinct(F.split(kept, "")), "")

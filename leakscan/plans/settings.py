"""The settings the registered scans run under, for Spark and for SQL."""

from __future__ import annotations

from datetime import datetime, timezone
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators import policy as pol
from leakscan.operators.rules import STARTER_PACK
from leakscan.plans.inputs import AS_OF, for_spark
from leakscan.plans.oracle import re2

NOW = datetime.fromisoformat(AS_OF).replace(tzinfo=timezone.utc)

PROFILES = [
    ("chatgpt.com", "ChatGPT", True, "relaxed", True, True, "placeholder"),
    ("chat.openai.com", "ChatGPT", True, "strict", False, True, "partial-mask"),
    ("claude.ai", "Claude", True, "balanced", True, False, "full-redact"),
    ("gemini.google.com", "Gemini", False, "relaxed", True, True, "partial-mask"),
]

PATTERN_SCHEMA = (
    "id string, label string, pattern string, flags string, category string, enabled boolean, "
    "explanation string, placeholder string"
)
CUSTOM = [
    # Runs of hex digits, a repeated syllable, one switched off, one broken.
    ("hex-blob", "Hex blob", r"\b[0-9A-F]{32,}\b", "gi", "secret", True, None, None),
    ("syllables", "Repeated syllables!", "(?:que|aux){2,40}", "g", "pii", True, "Looks foreign.", "<SYLLABLES>"),
    ("off", "Never", "e", "g", "secret", False, None, None),
    ("broken", "Broken", "(", "g", "secret", True, None, None),
]
CUSTOM_SQL = [
    {
        "id": "hex-blob", "label": "Hex blob", "category": "secret", "re2": r"(?i)\b[0-9a-f]{32,}\b",
        "explanation": 'This matches the custom pattern "Hex blob".', "placeholder": "<HEX_BLOB>",
    },
    {
        "id": "syllables", "label": "Repeated syllables!", "category": "pii", "re2": "(?:que|aux){2,40}",
        "explanation": "Looks foreign.", "placeholder": "<SYLLABLES>",
    },
]

WORKSPACE = [
    ("w1", "Example mail", r"@example\.com$", "gi", True, 0),
    ("w2", "Broken", "(", "g", True, 1),
    ("w3", "Off", "password", "i", False, 2),
    ("w4", "Firebase lines", r"^FIREBASE\s|config\s+AIza", "im", True, 3),
]
WORKSPACE_SQL = [r"(?i)@example\.com$", r"(?im)^FIREBASE\s|config\s+AIza"]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, pol.PROFILE_SCHEMA)


def profile_values() -> str:
    """The profiles as a SQL CTE ``profiles``."""
    rows = ", ".join(
        f"('{h}', '{l}', {e}, '{s}', {p}, {a}, '{m}')" for h, l, e, s, p, a, m in PROFILES
    )
    return (
        "profiles(hostname, label, enabled, strictness, scan_on_paste, scan_attachments, redaction_mode) "
        f"AS (VALUES {rows})"
    )


def custom(spark: SparkSession) -> DataFrame:
    return pol.normalize_custom(spark.createDataFrame(CUSTOM, PATTERN_SCHEMA))


def workspace(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        WORKSPACE, "id string, label string, pattern string, flags string, enabled boolean, pos int"
    )
    return pol.normalize_workspace(rows)


def allow_rules(spark: SparkSession, folder: str, source: str) -> DataFrame:
    return pol.normalize_exact_allow(for_spark(spark, folder, source), NOW)


def starter_sql_rules() -> list[dict]:
    out = []
    for n, p in enumerate(STARTER_PACK["patterns"]):
        identity = "\n".join([STARTER_PACK["name"], str(n), p["label"], p["pattern"]])
        out.append({**p, "id": sha256(identity.encode()).hexdigest(), "re2": re2(p["pattern"], p["flags"])})
    return out


def bigints(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, the type SQL engines agree on."""
    whole = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "short", "byte")]
    return df.withColumns({c: F.col(c).cast("bigint") for c in whole}) if whole else df

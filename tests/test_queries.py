"""Every registered query against its SQL counterpart, and the plans behind them."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as repo
from given import TESTDATA
from leakscan import plans
from leakscan.operators import detect
from leakscan.operators.policy import Policy
from leakscan.plans import settings as st
from leakscan.plans.inputs import for_spark
from leakscan.sources.tables import table

FOLDER = TESTDATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")

# The optional subpackage has its own tests.
QUERIES, SQL = plans.queries(), plans.oracle_sql()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 100
    assert set(QUERIES) <= set(repo.queries()) and set(SQL) <= set(repo.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, str(FOLDER))
    text = plan(got)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "RoundRobinPartitioning", "Python", "InPandas"):
        assert operator not in text
    expected = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in got.dtypes} == kinds
    ours = sorted(repr([r[c] for c in names]) for r in got.collect())
    at = [expected.columns.index(c) for c in names]
    assert ours == sorted(repr([r[i] for i in at]) for r in expected.fetchall())


def test_entry(spark):
    assert repo.entry(spark).count() == 11


# --- plans -------------------------------------------------------------------


def test_scan_is_narrow_and_reads_two_columns(spark):
    scanned = detect.scan(table(spark, str(FOLDER), "documents")).select("doc_id", F.inline("findings"))
    text = plan(scanned)
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_reader(spark):
    documents = table(spark, str(FOLDER), "documents").filter("lang = 'fr' AND doc_id > 10")
    text = plan(detect.scan(documents).select("doc_id", "findings"))
    assert "EqualTo(lang,fr)" in text and "GreaterThan(doc_id,10)" in text


def test_a_filter_on_findings_does_not_repeat_the_scan(spark):
    scanned = detect.scan(table(spark, str(FOLDER), "documents"))
    once = plan(scanned.select("doc_id", "findings")).count("regexp_replace(")
    again = plan(scanned.filter(F.size("findings") > 0).select("doc_id", F.inline("findings"))).count("regexp_replace(")
    assert once == again


def test_exact_allow_rules_ride_along_with_their_host(spark):
    policy = Policy(profiles=st.profiles(spark), exact_allow=st.allow_rules(spark, str(FOLDER), "seeded_allow"))
    texts = for_spark(spark, str(FOLDER), "seeded")
    scanned = detect.scan(texts, policy, host_col="hostname", as_of=st.NOW)
    text = scanned._jdf.queryExecution().optimizedPlan().toString()
    # The hosts, and the rules of each, are broadcast by a hint: a row for each supported host, of bounded size.
    assert text.count("strategy=broadcast") == 2 and "Limit" not in text
    assert "CartesianProduct" not in plan(scanned) and "BroadcastNestedLoopJoin" not in plan(scanned)
    # The rules of the scan are there once, and texts are not hashed.
    without = detect.scan(texts, Policy(profiles=st.profiles(spark)), host_col="hostname")
    assert plan(scanned).count("split(regexp_replace(") == plan(without).count("split(regexp_replace(")
    assert "xxhash64" not in plan(scanned)

import brute
import duckdb
import pytest
import corpus_pipeline
import public_tokenizers
import tiktoken
from llm_given import SMALL
from leakscan.llm import queries, tiling
from test_texts import ranks  # noqa: F401


def test_each_stage_does_its_work(spark, docs, texts, ranks):  # noqa: F811
    steps = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    stay = {r.doc_id: r.text for r in steps["language ID"](spark, docs, SMALL).collect()}
    assert stay == {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}

    prints = {i: brute.fingerprint(t) for i, t in stay.items()}
    groups = brute.groups(stay, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    stay = {i: t for i, t in stay.items() if groups[i] == i}
    cut = {i: kept for i, found, kept in brute.without_repeats(sorted(stay.items())) if kept or not found}

    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = spark.createDataFrame([(i, " ".join(k)) for i, k in cut.items()], "doc_id long, text string")
    leaked = {r.doc_id for r in tiling.contaminated(rows, benchmark).collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(out) == set(cut) - leaked

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in out.items():
        text = reference.decode(r.ids)
        assert text.split() == " ".join(cut[i]).split() and r.ids == reference.encode_ordinary(text)
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == brute.sha(text)


def test_stages_take_odd_and_empty_tables(spark, docs):
    rows = [
        (1, "A text about something, and nothing else", None, "s", None),
        (None, "A row without an id that stays where it is", "en", None, 4),
        (None, None, None, None, None),
        (2, "", "de", "s", 0),
        (2, "12 34", "de", "s", 5),
    ]
    odd = spark.createDataFrame(rows, docs.schema)
    for table, ids in ((odd, [None, 1]), (odd.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SMALL)
            assert table.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, table, SMALL)
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
    got, expected = queries.QUERIES[name](spark, SMALL), duck.sql(queries.SQL[name])
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_names_of_queries():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))

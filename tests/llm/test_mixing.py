import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from llm_given import SMALL
from leakscan.llm import mixing, queries, ranks


def plain_targets(sizes, weights=(5, 2, 1), most=3, share=1.0):
    """The excess of full sources is shared out again until none is above its limit."""
    ordered = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(ordered)}
    target, full, left = {}, set(), sum(sizes.values()) * share
    while True:
        open_ones = [s for s in ordered if s not in full]
        total = sum(weight[s] for s in open_ones)
        over = [s for s in open_ones if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_ones}
        for s in over:
            full.add(s)
            target[s] = most * sizes[s]
            left -= target[s]


def plain_mix(rows, weights_of=None, seed=mixing.SEED):
    """Rows (id, source, text) to (size, target, taken) of each."""
    size = [len(brute.WORD.findall(t or "")) for _, _, t in rows]
    sizes = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        sizes[s] += n
    target = plain_targets(dict(sizes))
    units = defaultdict(list)
    for k, (i, s, t) in enumerate(rows):
        name = str(i) if i is not None else "text:" + brute.sha(t or "")
        u = (int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        w = (weights_of or {}).get(i, 1.0)
        units[s, -math.log(u) / w if w > 0 else math.inf, name].append(k)
    out, so_far = [None] * len(rows), defaultdict(int)
    for s, key, name in sorted(units, key=lambda x: (str(x[0]), x[1], x[2])):
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        wanted = max(0.0, target[s] - whole * sizes[s])
        members = units[s, key, name]
        own = sum(size[k] for k in members)
        once_more = wanted > 0 and 2 * so_far[s] + own <= 2 * wanted
        so_far[s] += own
        for k in members:
            out[k] = size[k], target[s], size[k] * (whole + once_more)
    return out


def test_mix_matches_brute_force(spark, docs):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    liked = {r.doc_id: {1: queries.LIKED, 0: queries.DISLIKED}.get(r.quality, 1.0) for r in labels}
    found = {r.doc_id: (r.size, pytest.approx(r.target), r.taken) for r in queries.op11_source_mix(spark, SMALL).collect()}
    assert found == {i: x for (i, _, _), x in zip(rows, plain_mix(rows, liked))}
    again = {r.doc_id: r.taken for r in queries.op11_source_mix(spark, SMALL).collect()}
    assert again == {i: x[2] for i, x in found.items()}


def test_sources_that_fill_up(spark):
    """Null and empty sources, sources without words, and targets of several epochs."""
    rows = [(k, s, "w " * (k % 7 + 1)) for k in range(400) for s in ([None, "", "b", "B", "a"][k % 5 if k % 50 else 4],)]
    rows += [(1000 + k, "tiny", "x y") for k in range(3)] + [(2000, "none", None), (2001, "none", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(df).collect()
    expected = plain_mix(rows)
    assert sorted((r.doc_id, r.size, round(r.target, 6), r.taken) for r in found) == sorted(
        (i, n, round(t, 6), taken) for (i, _, _), (n, t, taken) in zip(rows, expected)
    )
    assert all(r.taken <= 3 * r.size for r in found)
    sums = defaultdict(int)
    for (_, s, _), (_, target, taken) in zip(rows, expected):
        sums[s, target] += taken
    assert all(abs(taken - target) <= 4 for (_, target), taken in sums.items())


def test_weights_prefer_and_put_last(spark):
    rows = [(k, "s" if k < 2000 else "t", "one two") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {k: [3.0, 1.0, 0.0, float("nan"), -1.0][k % 5] for k in range(2000)}
    quality = spark.createDataFrame([*weights.items(), (None, 2.0), (0, 3.0), (7, None)], "doc_id long, weight double")
    found = mixing.mix(df, quality, weights=(1, 9)).collect()
    taken = {r.doc_id: r.taken // r.size for r in found if r.doc_id < 2000}
    rate = [sum(taken[k] for k in taken if k % 5 == c) / 400 for c in range(5)]
    assert sum(taken.values()) == 400 and rate[0] > 1.5 * rate[1] > 0 and rate[2:] == [0, 0, 0]


def test_mix_of_odd_rows(spark, odd, none):
    rows = odd.withColumn("source", F.when(F.col("doc_id") > 3, "z")).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    given = [(r.doc_id, r.source, r.text) for r in rows.collect()]
    found = sorted((str(r.doc_id), r["size"], round(r.target, 6), r.taken) for r in mixing.mix(rows).collect())
    assert found == sorted((str(i), n, round(t, 6), taken) for (i, _, _), (n, t, taken) in zip(given, plain_mix(given)))
    whole = mixing.mixture(rows)
    assert whole.columns == [*rows.columns, "copies"]
    kept = sorted((str(r.doc_id), r.copies * len(brute.WORD.findall(r.text or ""))) for r in whole.collect())
    assert [x for x in kept if x[1]] == sorted((i, taken) for i, _, _, taken in found if taken)
    empty = none.withColumn("source", F.lit("a"))
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_numbers_follow_a_global_order(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS a", "id AS b").repartition(5)
    found = ranks.numbered(rows, F.col("a").desc(), F.col("b"), name="n").collect()
    expected = sorted(((r.a, r.b) for r in found), key=lambda x: (-x[0], x[1]))
    assert sorted((r.n, (r.a, r.b)) for r in found) == list(enumerate(expected, 1))
    assert ranks.numbered(rows.limit(0), F.col("a")).count() == 0

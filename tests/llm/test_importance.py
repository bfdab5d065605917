import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from llm_given import SMALL
from leakscan.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, longest, buckets=10_000, least=20, percent=10):
    def found(text):
        words = WORD.findall((text or "").translate(brute.LOWER))
        runs = [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, wanted = [found(t) for _, t in rows], Counter(b for t in target for b in found(t)[1])
    source = Counter(b for _, f in own for b in f)
    of_source, of_target = source.total() + buckets, wanted.total() + buckets
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * of_source / ((source[b] + 1) * of_target))) for b in source}
    out = []
    for (i, _), (n, f) in zip(rows, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_checksums_of_many_runs():
    draw = random.Random(5)
    data = bytes(draw.randrange(256) for _ in range(5000))
    spans = [(a, a + draw.choice([1, 2, 7, 63, 64, 65, 300])) for a in (draw.randrange(4600) for _ in range(400))]
    start, end = (np.array(x) for x in zip(*spans))
    got = importance.crc32s(np.frombuffer(data, np.uint8), start, end).tolist()
    assert got == [zlib.crc32(data[a:b]) for a, b in spans]


def test_query_matches_brute_force(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = queries.op12_importance_resampling(spark, SMALL)
    assert rows_of(found) == sorted(plain(rows, target, 1), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_across_lines(spark, odd, longest):
    target = spark.createDataFrame([("again and\nagain two lines",), (None,), ("",)], "text string")
    given = [(r.doc_id, r.text) for r in odd.collect()]
    extra = [(20, "a b\nc\n\nd e f\ng"), (21, "x\n" * 30), (22, "\n\n"), (23, "one " * 25 + "\n" + "one " * 25), (24, "Ab-cD é\x00z")]
    df = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    found = importance.resampled(df, target, longest=longest, buckets=500, least_words=10, percent=60)
    expected = plain(given + extra, [r.text for r in target.collect()], longest, 500, 10, 60)
    drop = [(str(i), *rest[:3]) for i, *rest in expected]
    assert sorted((str(r[0]), *r[1:4]) for r in rows_of(found)) == sorted(drop)
    # Rows without an id tie with each other; the others have their place.
    assert [r for r in rows_of(found) if r[0] is not None and r[0] not in (2, 11)] == sorted(
        (r for r in expected if r[0] is not None and r[0] not in (2, 11)), key=str
    )


def test_empty_tables(spark, odd, none, docs):
    target = docs.select("text")
    assert importance.resampled(none, target).count() == 0
    assert importance.resampled(odd, target.limit(0)).count() == odd.count()
    assert importance.drawn(none, target).count() == 0
    kept = importance.drawn(docs, target, percent=50)
    n = sum(len(WORD.findall(r.text.translate(brute.LOWER))) >= 20 for r in docs.collect())
    assert kept.columns == docs.columns and kept.count() == n // 2
    with pytest.raises(ValueError):
        importance.resampled(docs, target, buckets=0)

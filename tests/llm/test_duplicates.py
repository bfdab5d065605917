import tracemalloc

import numpy as np
import pytest

import brute
from leakscan.llm import embeddings, graph, hnsw, queries, simhash, substring
from llm_given import SMALL


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (300, 300), (2, 1)]
    rows = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    found = {r.node: r.component for r in graph.components(rows).collect()}
    expected = {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 180)} | {300: 300}
    assert found == expected
    assert graph.components(rows.limit(0)).count() == 0


def test_fingerprints_and_groups_match_brute_force(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    groups = brute.groups(texts, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in rows} == groups
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_close_fingerprints_of_all_cells_meet(spark):
    random = np.random.default_rng(3)
    base = random.integers(0, 2**63, 150).astype(np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in random.choice(64, n, replace=False))) for b in base for n in (1, 3, 4)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.array([0, 7, 2**64 - 1], np.uint64)]))
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for tile_rows in (4, 512):
        found = graph.components(simhash.links(rows, tile_rows=tile_rows)).collect()
        got = {r.node: r.component for r in found}
        names = fps.view(np.int64).tolist()
        number = dict(zip(names, fps.tolist()))
        expected = brute.groups(names, lambda a, b: (number[a] ^ number[b]).bit_count() <= 3)
        assert {i: got.get(i, i) for i in names} == expected


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    at = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert at[2].component_id == at[1].component_id == 1
    assert at[4].fingerprint == at[5].fingerprint == at[6].fingerprint == "0" * 16
    assert at[5].component_id == at[6].component_id == 4
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert simhash.near_duplicates(none).count() == 0


def check_cut(rows, frame):
    expected = sorted((i or -1, len(w), len(w) - len(k), brute.sha(" ".join(k))) for i, w, k in brute.without_repeats(rows))
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())
    assert got == expected


def test_substring_query_matches_brute_force(spark, texts):
    check_cut(list(texts.items()), queries.op10_substring_dedup(spark, SMALL))


def test_substring_of_odd_rows(odd, none):
    check_cut([(r.doc_id, r.text) for r in odd.collect()], substring.digests(odd))
    cut = substring.dedup(odd, removed_col="cut")
    assert cut.columns == [*odd.columns, "cut"]
    found = cut.collect()
    assert {(r.doc_id, r.text, r.score) for r in found if not r.cut} <= {(r.doc_id, r.text, r.score) for r in odd.collect()}
    kept = {r.doc_id: r.text for r in found if r.doc_id in (1, 2, 3)}
    assert kept[2] == "" and kept[3].split() == ["Before.", "row,", "and", "after"] and kept[1].startswith("the same")
    assert substring.dedup(none).count() == 0


def test_a_full_filter_changes_nothing(docs, monkeypatch):
    expected = sorted(map(tuple, substring.digests(docs).drop("longest_repeat").collect()))
    monkeypatch.setattr(substring, "FILTER_BYTES", 1)
    assert sorted(map(tuple, substring.digests(docs).drop("longest_repeat").collect())) == expected


def test_copies_that_pass_the_filter_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(substring, "FILTER_BYTES", 1)
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(k, text if k % 3 else f"{text} {k}") for k in range(1, 200)]
    check_cut(rows, substring.digests(spark.createDataFrame(rows, "doc_id long, text string")))


def test_repeats_are_followed_to_twice_their_length(spark):
    passage = " ".join(f"w{k}" for k in range(400))
    rows = [(1, passage), (2, "before " + passage + " after"), (3, "something else " * 20)]
    found = {r.doc_id: r.longest_repeat for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == found[2] and found[1] in (104, 208) and found[3] == 0


def test_every_repeat_has_its_length(spark, texts, odd):
    draw = np.random.default_rng(4)
    made = [[f"v{k}" for k in draw.integers(0, 1 << 40, 300)] for _ in range(40)]
    rows = []
    for k, passage in enumerate(made):
        n = int(draw.integers(10, 130))
        rows += [(3 * k, " ".join(passage)), (3 * k + 1, " ".join(["x", *passage[20 : 20 + n], *made[k - 1][150 : 150 + n], "y"]))]
        rows += [(3 * k + 2, " ".join(passage))] if k % 4 == 0 else []
    rows += [(1, " ".join(made[7])), (200, "short copy"), (201, "short copy")]
    whole = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    for some in (rows, whole, list(texts.items())):
        found = substring.digests(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert {r.doc_id: r.longest_repeat for r in found} == brute.longest_repeats(some)
    assert substring.digests(odd.filter("doc_id is null")).first().longest_repeat == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def cosine(x, y):
    x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
    return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def test_embeddings_match_brute_force(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 16))
    spread = [c + random.normal(size=16) * s for c in centres for s in (0.02, 0.1, 0.2, 0.3)]
    dense = [centres[0] + random.normal(size=16) * 0.05 for _ in range(150)]
    rows = [(3 * k, [float(v) for v in x]) for k, x in enumerate([*centres, *spread, *dense])]
    rows += [(1000, rows[5][1]), (1001, rows[5][1])]
    found = embeddings.near_duplicates(vectors(spark, rows), least_shards=3).collect()
    of = dict(rows)
    ids = sorted(of)
    linked = {(a, b) for a in ids for b in ids if a != b and cosine(of[a], of[b]) >= 0.95}
    assert {r.vec_id: r.n_links for r in found} == {i: sum((i, j) in linked for j in ids) for i in ids}
    assert {r.vec_id: r.component_id for r in found} == brute.groups(ids, lambda a, b: (a, b) in linked)


def test_rows_of_a_hot_group_do_not_pass_a_beam_that_misses_cold_links():
    random = np.random.default_rng(6)
    hot = random.normal(size=32) + 0.01 * random.normal(size=(1500, 32))
    cold = random.normal(size=(3000, 32))
    x = np.concatenate([hot, cold])
    shard = embeddings.Shard(np.arange(len(x)), np.ones(len(x), np.int64), x)

    class Narrow:
        """Finds nothing outside the hot group before the beam is 64 wide."""

        def search(self, queries, beam):
            near = queries @ shard.x.T
            node = np.argsort(-near, axis=1)[:, :beam]
            near = np.take_along_axis(near, node, axis=1)
            return (node, near) if beam >= 64 else (np.where(node < len(hot), node, -1), np.where(node < len(hot), near, -2))

    shard.graph = Narrow()
    assert shard._audited(shard.x[:: len(x) // 256][:256], 0.95) == 64


def test_few_pairs_connect_what_a_dense_block_links():
    random = np.random.default_rng(7)
    for density in (0.0, 0.02, 0.1, 0.6, 1.0):
        linked = random.random((40, 60)) < density
        few = embeddings.spanning(linked)
        assert len(few) < 100 and all(linked[i, j] for i, j in few)
        every = np.argwhere(linked)
        assert len(graph.forest(np.stack([every[:, 0], every[:, 1] + 40], axis=1))) == len(few)


def test_a_group_of_unequal_near_copies_is_never_listed_in_pairs():
    """Twenty thousand vectors that all link: 400 million pairs, in bounded memory."""
    random = np.random.default_rng(8)
    x = random.normal(size=32) + 0.01 * random.normal(size=(20_000, 32))
    shard = embeddings.Shard.__new__(embeddings.Shard)
    shard.ids, shard.sizes, shard.wide = np.arange(len(x)), np.full(len(x), 2), embeddings.unit(x)
    shard.x, shard.beam = shard.wide.astype(np.float32), embeddings.WIDEST + 1
    tracemalloc.start()
    counts, pairs = shard.links(shard.ids[5000:6024], x[5000:6024], 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [2 * (len(x) - 1)] * 1024 and len(graph.forest(pairs)) == len(x) - 1
    assert len(pairs) < 30_000 and peak < 500 << 20


def test_doubles_beyond_the_range_of_floats_link(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e300, 2.1e300]), (3, [1e-60, 2e-60]), (4, [1.0, 2.0]), (5, [5e-324, 1e-323]), (6, [-1e300, 1.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least_shards=2)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == [(k, 4, 1) for k in range(1, 6)] + [(6, 0, 6)]


def test_links_of_sampled_queries_are_recalled(spark):
    """Ids divisible by 100 against all rows, as the operator finds them, with shards that the graph has to search."""
    random = np.random.default_rng(9)
    own = np.repeat(random.normal(size=(1000, 32)), 5, axis=0) + 0.2 * random.normal(size=(5000, 32))
    ids = random.permutation(5000)
    table = spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, own)], "vec_id long, embedding array<double>")
    x = own / np.linalg.norm(own, axis=1, keepdims=True)
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, least_shards=3).filter("vec_id % 100 = 0").collect()}
    asked = np.flatnonzero(ids % 100 == 0)
    wanted = (x[asked] @ x.T >= 0.95).sum(axis=1) - 1
    got = np.array([found[i] for i in ids[asked].tolist()])
    assert (got <= wanted).all() and wanted.sum() > 50
    assert got.sum() / wanted.sum() >= 0.99


def test_embeddings_without_direction_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    lone = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None]]
    rows = [(k, v) for k, v in enumerate(lone)] + [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [1.0, 0.0, 0.0])]
    rows += [(None, [1.0, 0.0]), (10, [1.0, 0.0])]
    found = embeddings.near_duplicates(vectors(spark, rows), least_shards=2).collect()
    assert len(found) == len(rows)
    at = {(r.vec_id, r.component_id, r.n_links, r.kept) for r in found}
    assert {(k, k, 0, True) for k in range(6)} <= at
    assert {(10, 10, 2, True), (11, 10, 2, False), (12, 12, 0, True), (None, None, 0, True)} <= at
    for few in (rows[:3], []):
        assert embeddings.near_duplicates(vectors(spark, few)).count() == len(few)


@pytest.mark.parametrize("size", [1, 2, 30, 2000])
def test_graph_finds_the_nearest(size):
    x = np.random.default_rng(1).normal(size=(size, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = hnsw.Graph(x.astype(np.float32)).search(x[:200].astype(np.float32), 64)[0]
    assert (found[:, 0] == np.arange(len(found))).mean() > 0.99
    near = np.argsort(-(x[:200] @ x.T), axis=1)[:, : min(10, size)]
    recall = np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(near.tolist(), found.tolist())])
    assert recall > 0.9

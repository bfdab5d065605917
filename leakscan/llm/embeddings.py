"""Embedding near-dedup with small-world graphs, one per shard.

Vectors that are equal are taken once.  The others are dealt over shards; the
task of a shard builds its graph and then searches it for every vector of the
table, in blocks.  The beam starts narrow and is doubled until an audit of the
first block against a full comparison passes; a query whose whole beam links is
searched again with a wider one, in the end against the whole shard.  Cosines
are verified in double precision, and each task passes on counts and a spanning
forest of its links, so that a dense group never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, ShortType

from leakscan.llm.code import sent
from leakscan.llm.graph import components, forest
from leakscan.llm.hnsw import Graph
from leakscan.llm.store import stored

THRESHOLD = 0.95
SHARD_ROWS = 100_000  # bounds the graph that a task holds
LEAST_SHARDS = 6
BEAM = 16
WIDEST = 256
WIDER = 4
BLOCK = 1024
TILE = 4096  # rows of the shard that a block is compared with at a time
AUDITED = 256
RECALL = 0.99
SLACK = 1e-3  # below the threshold, for single-precision cosines


def usable(vector: Column) -> Column:
    """True for vectors with a direction: all components finite, one of them not zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda v: v != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows at length one; those whose squares would overflow or vanish are scaled first."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    odd = (largest > 1e150) | (largest < 1e-140)
    if odd.any():
        vectors = vectors.copy()
        # Powers of two, which change no digit.
        vectors[odd] = np.ldexp(vectors[odd], -np.frexp(largest[odd])[1][:, None])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spanning(linked: np.ndarray) -> np.ndarray:
    """Pairs (row, column), at most one for each of both, that connect what all true cells connect."""
    rows, columns = linked.shape
    group = np.arange(rows + columns)
    out: list[tuple[int, int]] = []
    while True:
        # Each row and column that has a cell between two groups gives one; groups that meet become one.
        apart = linked & (group[:rows, None] != group[None, rows:])
        i, j = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
        if not len(i):
            return np.array(out, np.int64).reshape(-1, 2)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for a, b in [*zip(i.tolist(), apart[i].argmax(axis=1).tolist()), *zip(apart[:, j].argmax(axis=0).tolist(), j.tolist())]:
            x, y = find(int(group[a])), find(int(group[rows + b]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        names, back = np.unique(group, return_inverse=True)
        group = np.array([find(x) for x in names.tolist()])[back]


class Shard:
    """The vectors of one shard, their graph, and a beam that has passed the audit."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.wide = unit(vectors)
        self.x = self.wide.astype(np.float32)
        self.graph = Graph(self.x)
        self.beam = 0

    def links(self, ids: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query how many rows of the table it links with here, and pairs (of ids) that connect what links."""
        wide = unit(vectors)
        queries = wide.astype(np.float32)
        if not self.beam:
            self.beam = self._audited(queries[:AUDITED], threshold)
        counts, pairs = np.zeros(len(ids), np.int64), []
        rest, beam = np.arange(len(ids)), self.beam
        while len(rest):
            if beam > WIDEST or beam >= len(self.ids):
                pairs += self._whole(rest, ids, queries, wide, threshold, counts)
                break
            node, near = self.graph.search(queries[rest], beam)
            close = (node >= 0) & (near >= threshold - SLACK)
            open_ = close.all(axis=1)
            i, j = np.nonzero(close & ~open_[:, None])
            i, j = rest[i], node[i, j]
            keep = ids[i] != self.ids[j]
            keep[keep] = self._verified(wide, i[keep], j[keep], threshold)
            i, j = i[keep], j[keep]
            np.add.at(counts, i, self.sizes[j])
            pairs.append(np.stack([ids[i], self.ids[j]], axis=1))
            rest, beam = rest[open_], beam * WIDER
        return counts, np.concatenate(pairs)

    def _verified(self, wide: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether query i and row j link, in double precision."""
        parts = [np.zeros(0, bool)]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            parts.append(np.einsum("nd,nd->n", wide[a], self.wide[b]) >= threshold)
        return np.concatenate(parts)

    def _whole(self, rest, ids, queries, wide, threshold: float, counts: np.ndarray) -> list[np.ndarray]:
        """Compare queries with the whole shard, a tile at a time: counts are added up, and few of the links kept."""
        pairs = [np.zeros((0, 2), ids.dtype)]
        for start in range(0, len(self.ids), TILE):
            here = slice(start, start + TILE)
            near = queries[rest] @ self.x[here].T
            linked = near >= threshold + SLACK
            i, j = np.nonzero((near >= threshold - SLACK) & ~linked)
            linked[i, j] = self._verified(wide, rest[i], j + start, threshold)
            linked &= ids[rest][:, None] != self.ids[here][None, :]
            counts[rest] += np.where(linked, self.sizes[here], 0).sum(axis=1)
            few = spanning(linked)
            pairs.append(np.stack([ids[rest[few[:, 0]]], self.ids[here][few[:, 1]]], axis=1))
        return pairs

    def _audited(self, queries: np.ndarray, threshold: float) -> int:
        """The first beam, doubling, that finds nearly all links of an audited row, on average over the rows.

        Audited are the first queries, and rows of the shard turned away from
        themselves to just above the threshold, each of which has a link.
        """
        random = np.random.default_rng(2)
        own = self.x[random.choice(len(self.x), min(AUDITED, len(self.x)), replace=False)]
        aside = random.normal(size=own.shape).astype(np.float32)
        aside -= np.einsum("nd,nd->n", aside, own)[:, None] * own
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-6)
        cosine = min(1.0, threshold + 0.2 * (1 - threshold))
        turned = cosine * own + np.sqrt(max(0.0, 1 - cosine**2)) * aside
        audit = np.concatenate([queries, turned]).astype(np.float32)
        wanted = (audit @ self.x.T >= threshold).sum(axis=1)
        beam = BEAM
        while beam < len(self.ids) and beam <= WIDEST:
            node, near = self.graph.search(audit, beam)
            got = ((near >= threshold - 1e-6) & (node >= 0)).sum(axis=1)
            # A full beam is searched again with a wider one: such a row says nothing about this beam.
            judged = (got < beam) & (wanted > 0)
            if judged.any() and np.minimum(got[judged] / wanted[judged], 1).mean() >= RECALL:
                break
            beam *= 2
        return beam


FOUND = "a long, b long, n long"
NAMES = ["a", "b", "n"]


def _searched(threshold: float):
    """Of each shard's rows (sorted: its own first, then all queries) counts of links and a forest."""

    def answer(shard: Shard, ids: np.ndarray, vectors: np.ndarray) -> list[pa.RecordBatch]:
        n, links = shard.links(ids, vectors, threshold)
        pairs = np.array(forest(links), np.int64).reshape(-1, 2)
        some = np.flatnonzero(n)
        counted = pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[some]), pa.array(n[some])], NAMES)
        joined = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())]
        return [counted, pa.RecordBatch.from_arrays(joined, NAMES)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, shard = None, [], None
        for batch in batches:
            names = batch.column("shard").to_numpy()
            kinds = batch.column("query").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(names) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                ids, sizes = (part.column(c).to_numpy() for c in ("id", "n"))
                flat = part.column("vector").flatten().to_numpy()
                vectors = flat.reshape(b - a, -1).astype(np.float64)
                if names[a] != name:
                    name, held, shard = names[a], [], None
                if not kinds[a]:
                    held.append((ids, sizes, vectors))
                    continue
                if shard is None and not held:
                    continue  # an empty shard
                if shard is None:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held))), []
                for k in range(0, b - a, BLOCK):
                    yield from answer(shard, ids[k : k + BLOCK], vectors[k : k + BLOCK])

    return run


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
    least_shards: int = LEAST_SHARDS,
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is ``threshold`` or
    more.  Null, zero and non-finite vectors, and those with a null component,
    link with nothing, and neither do vectors of different lengths or rows with
    a null id (their component is null, and they are kept).  Equal vectors link
    with each other; n_links counts other rows.  Rows that share an id are in
    one component.  An empty table gives an empty one; other columns are not
    read.
    """
    sent(table.sparkSession)
    # Components keep their width: floats are shuffled as such, and cosines are in double precision either way.
    element = table.schema[vector_col].dataType.elementType
    kind = "float" if isinstance(element, (ByteType, ShortType, FloatType)) else "double"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    good = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    rows = stored(rows.withColumn("good", good), "vectors")
    distinct = rows.filter("good").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    # Ids may repeat, so a class is named by its vector as well.
    named = stored(distinct.withColumn("class", F.xxhash64("id", "vector")), "distinct")
    lengths = named.groupBy(F.size("vector").alias("length")).agg(
        F.greatest(F.lit(least_shards), F.ceil(F.count(F.lit(1)) / shard_rows)).cast("int").alias("shards")
    )
    found = [r.asDict() for r in lengths.orderBy("length").collect()]
    searched = None
    for place, r in enumerate(found):
        here = named.filter(F.size("vector") == r["length"]).select("class", "n", "vector")
        own = here.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(r["shards"])).cast("int"))
        asked = here.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(r["shards"] - 1))))
        both = own.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))
        dealt = both.select("shard", "query", F.col("class").alias("id"), "n", "vector")
        # By range, so that no two shards share a task.
        dealt = dealt.repartitionByRange(r["shards"], "shard").sortWithinPartitions("shard", "query")
        part = dealt.mapInArrow(_searched(threshold), FOUND)
        searched = part if searched is None else searched.unionByName(part)
    if searched is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    links = stored(searched, "links")
    counts = links.filter("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    members = rows.filter("good").join(named, "vector").select("vec_id", "class")
    shared = members.groupBy("vec_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a != z")
    ids = shared.join(members, "vec_id").select("a", F.col("class").alias("b"))
    groups = components(links.filter("n is null").select("a", "b").unionByName(ids))
    grouped = named.join(groups, named["class"] == groups.node, "left").select(
        "class", "vector", "id", "n", F.coalesce("component", "class").alias("group")
    )
    first = grouped.groupBy("group").agg(F.min("id").alias("component_id"))
    classes = stored(
        grouped.join(first, "group")
        .join(counts, "class", "left")
        .select("vector", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "classes",
    )
    linked = rows.filter("good").join(classes, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept)

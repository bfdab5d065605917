"""SimHash near-dedup by tiled exact comparison.

A fingerprint holds the majority of the bits of its text's shingle hashes.
Distinct fingerprints are put into cells by the population counts of their
four quarters, and cells are cut into tiles.  Two fingerprints at Hamming
distance d have quarter counts that differ by at most d in total, so only
tiles of cells that close meet; each such pair of tiles is compared whole with
exclusive-or and bit counts.  No candidate step can miss a pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.llm.code import sent
from leakscan.llm.graph import components, forest
from leakscan.llm.store import stored
from leakscan.llm.words import lowered, sliced, utf8

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
TILE_ROWS = 512
QUARTER = 16


def majority(digests: bytes) -> int:
    """Bits set in over half of the 64-bit big-endian hashes."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    if not len(rows):
        return 0
    padded = np.zeros((-(-len(rows) // 255) * 255, 8), np.uint8)
    padded[: len(rows)] = rows
    bits = np.unpackbits(padded, axis=1).reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(rows)).tobytes(), "big")


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """Of a text whose letters A-Z are in lower case."""
    found = text.split()
    joined = b" ".join(found)
    if not found:
        return 0
    if len(found) < size:
        return majority(xxhash.xxh64_digest(joined, SEED))
    ends = list(itertools.accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp long), one per row of ``docs``; a null text reads as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, at = utf8(batch.column("text"))
            raw = lowered(data).tobytes()
            fps = np.fromiter((fingerprint(raw[a:b]) for a, b in itertools.pairwise(at.tolist())), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    sent(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _quarters(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]


def _cell(counts: list[Column], radius: int) -> Column:
    """One number for four counts, with room for a move of ``radius`` in each."""
    base = QUARTER + 1 + 2 * radius
    return sum(((c + radius) * base**k for k, c in enumerate(counts)), F.lit(0)).cast("int")


def _moves(radius: int) -> list[int]:
    """From a cell to itself and to half of its neighbours: the others meet it from their side."""
    base = QUARTER + 1 + 2 * radius
    near = itertools.product(range(-radius, radius + 1), repeat=4)
    half = [m for m in near if sum(map(abs, m)) <= radius and m >= (0, 0, 0, 0)]
    return [sum(step * base**k for k, step in enumerate(m)) for m in half]


def near(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs (of x, of y) at ``radius`` bits or fewer, as rows."""
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
    return np.stack([x[i], y[j]], axis=1)


def _compare(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("fps"), batch.column("others")
            lv, rv = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (left, right))
            lo, ro = (c.offsets.to_numpy().astype(np.int64) for c in (left, right))
            ln, rn = np.diff(lo), np.diff(ro)
            found = []
            small = ln * rn < 2048
            # Small tiles are compared many pairs at a time, large ones pair by pair.
            for rows in np.array_split(np.flatnonzero(small), max(1, int((ln * rn)[small].sum()) >> 20)):
                n = ln[rows] * rn[rows]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat(rn[rows], n)
                x = lv[np.repeat(lo[rows], n) + within // width]
                y = rv[np.repeat(ro[rows], n) + within % width]
                close = np.bitwise_count(x ^ y) <= radius
                found.append(np.stack([x[close], y[close]], axis=1))
            for k in np.flatnonzero(~small):
                found.append(near(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], radius))
            links = np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)
            pairs = np.array(forest(links[links[:, 0] != links[:, 1]]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``radius`` bits.

    ``fps`` has a column fp without repeats.  What each task finds is thinned
    to a spanning forest, so a dense group leaves as many links as members.
    """
    celled = fps.select("fp", _cell(_quarters(F.col("fp")), radius).alias("cell"))
    cells = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("blocks"))
    tiles = stored(
        celled.join(F.broadcast(cells), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    here = tiles.select(F.col("cell").alias("to")).distinct()
    left = (
        tiles.select("*", F.explode(F.array(*map(F.lit, _moves(radius)))).alias("move"))
        .select("cell", "block", "fps", (F.col("cell") + F.col("move")).alias("to"))
        .join(F.broadcast(here), "to", "left_semi")
    )
    right = tiles.select(F.col("cell").alias("to"), F.col("block").alias("other"), F.col("fps").alias("others"))
    pairs = left.join(right, "to").filter("cell != to or block <= other").select("fps", "others")
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, kept.

    Texts link when their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest doc_id reachable.  Null and empty texts have
    fingerprint zero and link like any other; rows of one doc_id share their
    component; a null doc_id links with nothing, has a null component and is
    kept.  An empty table gives an empty one; other columns are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    named = fps.filter("doc_id is not null")
    distinct = stored(named.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Rows that share an id are one document, even with different texts.
    many = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b")
    ids = named.join(many.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b"))
    found = components(links(distinct, radius, tile_rows).unionByName(ids))
    grouped = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named_fp = stored(grouped.join(first, "component").select("fp", "component_id"), "classes")
    out = fps.join(named_fp, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )

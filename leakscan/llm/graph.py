"""Connected components of an edge table, by alternating stars.

Each round points the neighbours of a node at the smallest of them: first the
larger ones (large star), then the smaller ones (small star), until the edges
form stars around the smallest member (Kiveris and others, 2014).  Minima are
aggregated before they are shuffled and meet the edges in a join, so a node
with very many edges is never gathered into one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.store import dropped, stored


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links as connect what all of them connect."""
    root: dict[int, int] = {}
    out = []
    for a, b in links.tolist():
        x, y = a, b
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        while (up := root.get(y, y)) != y:
            root[y] = y = root.get(up, up)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is its smallest node.

    Self-links and repeated links change nothing; rows with a null end are
    left out; an empty table gives an empty one.
    """
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    star = stored(first.filter("u is not null and v is not null").distinct(), "edges")
    nodes = stored(
        star.select(F.col("u").alias("node")).unionByName(star.select(F.col("v").alias("node"))).distinct(), "nodes"
    )
    star = _replaced(star, star.filter("u != v"))
    while True:
        again = stored(_small_star(_large_star(star)), "edges")
        changed = not _same(star, again)
        dropped(star)
        star = again
        if not changed:
            break
    return nodes.join(star, nodes.node == star.u, "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    kept = stored(new, "edges")
    dropped(old)
    return kept


def _same(x: DataFrame, y: DataFrame) -> bool:
    def summary(df):
        return df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()

    return summary(x) == summary(y)

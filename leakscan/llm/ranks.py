"""Numbering the rows of a table in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm.store import stored

PLACE_BITS = 33  # of monotonically_increasing_id, for the row of a partition


def numbered(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in the given order; rows that tie in all of it come in any order.

    ``rows`` is read twice, once for the bounds of the ranges: pass a stored table.
    The rows are sorted in ranges and stored with their place; a row's number is
    its place and the sizes of the ranges before its own.  What is added up in
    one task, and broadcast, has one row for each partition of the sort.
    """
    place = F.monotonically_increasing_id().alias("__place")
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place), "numbered")
    part = F.shiftright("__place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__before"))
    met = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    number = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return met.withColumn(name, number).drop("__part", "__place", "__before")

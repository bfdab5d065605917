"""Shards by a lookup table filled from permutations.

Each shard prefers the slots of a prime-sized table in an order of its own.
The shards take turns, each claiming the first slot of its order that is free,
until the table is full: every shard has almost the same number of slots, and
when a shard goes, few slots of the others move.  The table is small, is
broadcast, and places a row with one hash and one lookup.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537  # a prime; the table that is broadcast never has more rows
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the index of the shard that claims it."""
    if not _prime(slots) or slots > SLOTS:
        raise ValueError(f"slots must be a prime up to {SLOTS}")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must be distinct, one at least, and no more than slots")
    offset = [xxhash.xxh64_intdigest(s.encode(), 1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s.encode(), 2) % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, np.int32)
    at, left = list(offset), slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from the first 32 bits of its MD5; null counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def placed(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with slot and shard appended, columns of these names replaced.

    Equal keys go to the same shard, rows with a null key all to one; no
    text is read and no row is moved.  An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    names = [c for c in docs.columns if c not in ("slot", "shard")]
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    place = {n: f"c{k}" for k, n in enumerate(docs.columns)}
    table = spark.createDataFrame(
        [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, slots).tolist())], "slot int, shard string"
    )
    rows = plain.withColumn("slot", slot_of(F.col(place[key_col]), slots)).join(F.broadcast(table), "slot")
    return rows.select(*[F.col(place[n]).alias(n) for n in names], "slot", "shard")

"""Sets of 64-bit keys, shuffled as packed blobs and kept in a filter of fixed size.

Keys are cut into segments of equal key range.  A task sends each segment one
sorted blob per couple of million keys, so a key that occurs everywhere leaves
a task once, and no row of the shuffle belongs to a single key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBES = 4
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def segments_of(spark: SparkSession) -> int:
    """Four segments for each shuffle partition: what one task holds shrinks as partitions grow."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def segment(keys: np.ndarray, count: int) -> np.ndarray:
    """The segment of each key; grows with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def cut(keys: np.ndarray, count: int) -> Iterator[tuple[int, int, int]]:
    """(segment, from, to) of sorted keys, for each segment that has any."""
    edges = np.searchsorted(segment(keys, count), np.arange(count + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, int(edges[k]), int(edges[k + 1])


def gathered(batches: Iterable[pa.RecordBatch]) -> dict[int, list[tuple[bytes, ...]]]:
    """The blobs of each segment in this partition; the first column is the segment."""
    found: dict[int, list[tuple[bytes, ...]]] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for k, *blobs in zip(*columns):
            found.setdefault(k, []).append(tuple(blobs))
    return found


def _places(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys * _ODD[probe]
        h ^= h >> np.uint64(29)
        return (((h * _ODD[(probe + 1) % 4]) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def filter_bytes(items: int | None, bits: float, most: int | None) -> int:
    """Room for ``items`` at ``bits`` each, at least 64 KB, and ``most`` bytes at most if given."""
    room = max(1 << 16, int((items or 0) * bits / 8))
    return room if most is None else min(most, room)


class Filter:
    """A Bloom filter of ``count`` segments, each with its own run of whole bytes.

    It may hold only the segments from ``first`` to ``stop`` (excluded).
    """

    def __init__(self, count: int, total_bytes: int, first: int = 0, stop: int | None = None):
        self.count, self.first, self.stop = count, first, count if stop is None else stop
        self.size = max(8, total_bytes // count)
        self.bytes = np.zeros(0, np.uint8)

    def one(self, keys: np.ndarray) -> bytes:
        """The bytes of one segment that holds these keys (or names made from keys of that segment)."""
        bits = np.zeros(self.size * 8, bool)
        for probe in range(PROBES):
            bits[_places(keys, len(bits), probe)] = True
        return np.packbits(bits).tobytes()

    def filled(self, rows: Iterable[tuple[int, bytes]]) -> Filter:
        self.bytes = np.zeros((self.stop - self.first) * self.size, np.uint8)
        for k, blob in rows:
            at = (k - self.first) * self.size
            self.bytes[at : at + self.size] = np.frombuffer(blob, np.uint8)
        return self

    def covers(self, keys: np.ndarray) -> np.ndarray:
        """Whether the segment of each key is held."""
        if self.stop - self.first == self.count:
            return np.ones(len(keys), bool)
        found = segment(keys, self.count)
        return (found >= self.first) & (found < self.stop)

    def fill(self) -> float:
        """The share of bits that are set."""
        return float(np.bitwise_count(self.bytes).sum()) / max(1, 8 * len(self.bytes))

    def holds(self, keys: np.ndarray, home: np.ndarray | None = None) -> np.ndarray:
        """True for every key put in, and for few others while the filter is not full.

        ``home`` has the keys that the segments go by, where names were put in.
        """
        base = (segment(keys if home is None else home, self.count) - self.first) * (self.size * 8)
        found = np.ones(len(keys), bool)
        alive = np.arange(len(keys))
        for probe in range(PROBES):
            at = base[alive] + _places(keys[alive], self.size * 8, probe).astype(np.int64)
            hit = (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            found[alive[~hit]] = False
            alive = alive[hit]
        return found


BLOB = pa.schema([("segment", pa.int32()), ("keys", pa.binary())])
PACKED = "segment int, keys binary"


def packed(keys: np.ndarray, count: int) -> pa.RecordBatch:
    """Rows (segment, keys) of sorted keys."""
    return pa.RecordBatch.from_pylist([{"segment": k, "keys": keys[a:b].tobytes()} for k, a, b in cut(keys, count)], BLOB)


def broadcast_filter(parts: DataFrame, count: int, total_bytes: int, chosen) -> Broadcast:
    """A filter, broadcast, of the keys that ``chosen`` takes from all blobs of a segment.

    ``parts`` has rows (segment, keys).  What reaches the driver has ``total_bytes``, whatever the input.
    """
    empty = Filter(count, total_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blobs in gathered(batches).items():
            keys = chosen(np.concatenate([np.frombuffer(b, np.uint64) for (b,) in blobs]))
            yield pa.RecordBatch.from_pylist([{"segment": k, "keys": empty.one(keys)}], BLOB)

    rows = parts.repartition(max(1, count // 4), "segment").mapInArrow(run, PACKED).toLocalIterator()
    return parts.sparkSession.sparkContext.broadcast(Filter(count, total_bytes).filled((r.segment, r["keys"]) for r in rows))


def id_filter(ids: DataFrame, count: int, most: int) -> Broadcast:
    """A filter of the long ids in the first column of ``ids``, for :func:`maybe`.

    It has two bytes for each id, and ``most`` bytes at most.
    """
    total_bytes = filter_bytes(ids.count(), 16, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(np.sort(batch.column("key").to_numpy().view(np.uint64)), count)

    keys = ids.select(F.xxhash64(ids.columns[0]).alias("key"))
    return broadcast_filter(keys.mapInArrow(run, PACKED), count, total_bytes, lambda found: found)


def maybe(known: Filter, column: pa.Array) -> np.ndarray:
    """For each xxhash64 of an id, False only if the id is not in the filter."""
    return known.holds(column.to_numpy(zero_copy_only=False).view(np.uint64))

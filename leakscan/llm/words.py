"""Words of whole texts as arrays, straight from Arrow's buffers.

A word is a run of bytes other than space and \\x09-\\x0D.  Everything here works
on one slice of a batch at a time, so memory is bounded by the slice or by the
longest text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
NARROW_BYTES = 1 << 20  # where many numbers are made of each byte
SPACES = (0x20, *range(0x09, 0x0E))

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_VALUE = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (a splitmix finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers_up_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 2 * len(_powers), 64), _STEP, np.uint64)
            grown[0] = 1
            _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


_kept: dict[str, Any] = {}


def kept(key: str, build: Callable[[], Any]) -> Any:
    """What tasks of one kind need again and again, built once in a worker process; one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def let_go(using: str | None = None) -> None:
    """Drop what tasks of other kinds kept in this worker process."""
    if _kept and using not in _kept:
        _kept.clear()
        hand_back()


def hand_back() -> None:
    """Give free memory back to the system: workers stay for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def sliced(
    batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, using: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold ``most`` bytes, or one text.

    What the worker keeps goes first, unless the task is ``using`` it.
    """
    let_go(using)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    hand_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or offsets.size == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of the texts of one slice, in order."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text, index of its first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return byte_hashes(self.data, self.start, self.end)

    def raw(self, i: int, j: int) -> list[bytes]:
        """The words from index i to j (excluded) as bytes."""
        data = self.data.data
        return [bytes(data[a:b]) for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> Words:
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(n + 1, np.int64))
    inside = is_word[data]
    full = np.flatnonzero(np.diff(offsets))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets[full]] = inside[offsets[full]]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), none of them empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.cumsum(size) - size
    within = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
    values = _BYTE_VALUE[data[within + np.repeat(start, size)]]
    with np.errstate(over="ignore"):
        values *= _powers_up_to(int(size.max()) + 1)[within]
        return mixed(np.add.reduceat(values, at) + size.astype(np.uint64) * _STEP)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, by start; they may span texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size > len(_PLACE_VALUE):
        raise ValueError(f"windows hold at most {len(_PLACE_VALUE)} words")
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += hashes[k : k + n] * _PLACE_VALUE[k]
    return mixed(out)


def whole_windows(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of ``n`` window starts, those whose window lies in one text."""
    ok = np.zeros(n, bool)
    if n:
        change = np.zeros(n + 1, np.int64)
        stop = np.maximum(first[1:] - size + 1, first[:-1])
        np.add.at(change, np.minimum(first[:-1], n), 1)
        np.add.at(change, np.minimum(stop, n), -1)
        ok = np.cumsum(change[:-1]) > 0
    return ok

"""Benchmark decontamination by greedy string tiling, with running Karp-Rabin matching.

Documents and benchmark items share seeds: runs of ``min_words`` words, or a
whole item that is shorter.  Where a document's seeds could cover enough of an
item, the two are tiled: windows of one length, over words that are not marked
yet, are hashed from running sums of both texts; the greatest length at which
the two share a window is looked for, every such window is marked, compared
word by word, no word twice, and the search goes on at lesser lengths.  The
share of the item's words under tiles decides, so passages whose parts were put
in another order count like untouched ones.

The benchmark is taken in blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.code import sent
from leakscan.llm.words import NARROW_BYTES, Words, sliced, utf8, whole_windows, windows, words

MIN_WORDS = 5
THRESHOLD = 0.6  # untouched and reordered passages cover nearly all of an item, chance ones a third at most
BLOCK_WORDS = 2_000_000  # words of benchmark broadcast at a time

# Words are runs of ASCII letters and digits and of any longer characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> Words:
    """The lower-case words of each text."""
    return words(*utf8(pc.utf8_lower(column)), _IN_WORD)


class Running:
    """Hashes of windows of any length over a row of word hashes, from one running sum."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.free = np.ones(len(hashes), bool)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), _BASE, np.uint64)), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.powers[:-1], dtype=np.uint64)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of unmarked words start, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[size:] == taken[: len(taken) - size])
        with np.errstate(over="ignore"):
            # To one power for all, so that a window's hash does not depend on its place.
            return at, (self.sums[at + size] - self.sums[at]) * self.powers[len(self.hashes) - at]


def _aligned(doc: Running, item: Running, size: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The free windows of both, their hashes taken to the same power."""
    (i, x), (j, y) = doc.windows(size), item.windows(size)
    shift = len(doc.hashes) - len(item.hashes)
    with np.errstate(over="ignore"):
        if shift > 0:
            y = y * doc.powers[shift]
        elif shift < 0:
            x = x * item.powers[-shift]
    return (i, x), (j, y)


def tiles(doc: np.ndarray, item: np.ndarray, least: int, same=None) -> list[tuple[int, int, int]]:
    """Tiles (doc place, item place, length) of ``least`` words or more, longest first.

    Of equally long ones the first in the item, then in the document, goes
    first.  Marked words are never used again.  ``same(i, j, size)`` compares the
    words themselves.
    """
    left, right, out = Running(doc), Running(item), []
    most = min(len(doc), len(item))
    while most >= least:
        # If a window is shared, so are shorter ones: the greatest length is found by halving.
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            (_, x), (_, y) = _aligned(left, right, middle)
            low, high = (middle, high) if len(np.intersect1d(x, y)) else (low, middle - 1)
        size = low
        if size < least:
            break
        (i, x), (j, y) = _aligned(left, right, size)
        shared = np.intersect1d(x, y)
        order = np.argsort(x, kind="stable")
        starts, stops = (np.searchsorted(x[order], shared, side) for side in ("left", "right"))
        # Of each window its places in the document; those used up stay used up.
        places = {h: iter(i[order[a:b]].tolist()) for h, a, b in zip(shared.tolist(), starts.tolist(), stops.tolist())}
        for b, h in zip(j.tolist(), y.tolist()):
            if h not in places or not right.free[b : b + size].all():
                continue
            for a in places[h]:
                if left.free[a : a + size].all() and (doc[a : a + size] == item[b : b + size]).all() and (same is None or same(a, b, size)):
                    left.free[a : a + size] = right.free[b : b + size] = False
                    out.append((a, b, size))
                    break
        most = size - 1
    return out


class Block:
    """Some items of the benchmark: their words, and their seeds by hash."""

    def __init__(self, ids: list, column: pa.Array, least: int):
        self.ids, self.least = ids, least
        self.words = tokens(column)
        self.hashes, self.first = self.words.hashes(), self.words.first
        self.sizes = self.words.counts
        self.seeds = {}
        # An item shorter than a seed is a seed itself.
        for size in sorted({min(least, n) for n in self.sizes.tolist() if n}):
            wanted = self.sizes >= least if size == least else self.sizes == size
            seeds = windows(self.hashes, size)
            at = np.flatnonzero(whole_windows(self.first, size, len(seeds)))
            row = np.searchsorted(self.first, at, "right") - 1
            at, row = at[wanted[row]], row[wanted[row]]
            order = np.argsort(seeds[at], kind="stable")
            low = np.zeros(1 << 20, bool)
            low[seeds[at] & np.uint64(0xFFFFF)] = True
            self.seeds[size] = seeds[at][order], row[order], (at - self.first[row])[order], low

    def _likely(self, hashes: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(text, item) where the seeds of the text could cover enough of the item."""
        for size, (seeds, row, place, low) in self.seeds.items():
            own = windows(hashes, size)
            at = np.flatnonzero(low[own & np.uint64(0xFFFFF)] & whole_windows(first, size, len(own)))
            a, b = (np.searchsorted(seeds, own[at], side) for side in ("left", "right"))
            at, a, b = (x[b > a] for x in (at, a, b))
            if not len(at):
                continue
            # A seed that a text has often counts once, so a repetitive text is no heavier than another.
            text = np.searchsorted(first, at, "right") - 1
            _, once = np.unique(text * len(seeds) + a, return_index=True)
            text, a, n = text[once], a[once], (b - a)[once]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - a, n)
            pair = np.repeat(text, n) * len(self.sizes) + row[k]
            order = np.argsort(pair, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0, [True]]))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                here, item = divmod(int(pair[order[x]]), len(self.sizes))
                total = int(self.sizes[item])
                change = np.zeros(total + 1, np.int64)
                covers = place[k[order[x:y]]]
                np.add.at(change, covers, 1)
                np.add.at(change, covers + size, -1)
                if np.count_nonzero(np.cumsum(change)[:total]) >= threshold * total:
                    yield here, item

    def matches(self, batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(row of the batch, item, covered words, longest tile) of contaminated documents."""
        found = tokens(batch.column("text"))
        hashes, first = found.hashes(), found.first
        for row, item in self._likely(hashes, first, threshold):
            total = int(self.sizes[item])
            here, there = int(first[row]), int(self.first[item])

            def same(i: int, j: int, size: int) -> bool:
                return found.raw(here + i, here + i + size) == self.words.raw(there + j, there + j + size)

            doc, own = hashes[here : int(first[row + 1])], self.hashes[there : there + total]
            marked = tiles(doc, own, min(self.least, total), same)
            covered = sum(size for _, _, size in marked)
            if covered >= threshold * total:
                yield row, item, covered, max(size for _, _, size in marked)


def _blocks(benchmark: DataFrame, least: int, most: int) -> Iterator[Block]:
    """Blocks of ``most`` words or one item, read one row at a time."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for row in benchmark.filter("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        size = row.text.count(" ") + 1
        if held and held + size > most:
            yield Block(ids, pa.array(texts, pa.string()), least)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += size
    if ids:
        yield Block(ids, pa.array(texts, pa.string()), least)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = MIN_WORDS,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows (doc_id, item_id, item_words, covered, coverage, longest): items found in documents.

    An item is found when tiles of ``min_words`` words or more cover at least
    ``threshold`` of its words, or, if it has fewer words, when it occurs whole.
    Items without words match nothing, nor do null texts and items with a null
    id; a row of ``docs`` with a null id is reported with that null.  Repeated
    rows, of either table, are each reported.
    """
    spark = sent(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    schema = "doc_id long, item_id long, item_words int, covered int, coverage double, longest int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, min_words, block_words):
        out = out.unionByName(rows.mapInArrow(_matcher(spark.sparkContext.broadcast(block), threshold), schema))
    return out


def _matcher(block, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in sliced(batches, most=NARROW_BYTES):
            found = list(items.matches(batch, threshold))
            row, item, covered, longest = (np.array([f[k] for f in found], np.int32) for k in range(4))
            total = items.sizes[item].astype(np.int32)
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array([items.ids[k] for k in item.tolist()], pa.int64()),
                pa.array(total),
                pa.array(covered),
                pa.array(covered / np.maximum(total, 1), pa.float64()),
                pa.array(longest),
            ]
            names = ["doc_id", "item_id", "item_words", "covered", "coverage", "longest"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run

"""Importance resampling towards a target, with features counted by distinct lines.

Features are runs of up to ``longest`` consecutive words, hashed into buckets.
How much likelier a feature's bucket is in the target than in the documents is
its gain; a document's weight is the mean gain of its features, and documents
are drawn without replacement by weight plus Gumbel noise.

Separator newlines cut texts into lines.  A line that occurs often is counted
once: distinct lines meet in a shuffle, each one's features are counted there
and multiplied by its occurrences.  Runs that cross a line's end are no line's
own and are added from the texts.  When documents are weighed, the distinct
lines of a slice of texts are again looked at once, and their gains are added up
by document, so that a line of very many documents is no task's burden.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.code import sent
from leakscan.llm.ranks import numbered
from leakscan.llm.store import stored
from leakscan.llm.words import NARROW_BYTES, Words, lowered, sliced, utf8, words

BUCKETS = 10_000
MOST_BUCKETS = 1 << 20  # the gains are broadcast
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
SHORT = 64  # bytes of a feature that is hashed with others

# Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
_IS_WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _IS_WORD[_low : _high + 1] = True


def crc_of_bytes() -> np.ndarray:
    """What each byte, as the last one, adds to a crc32."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    return one


def _crc_tables(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """What a byte with k bytes after it adds to a crc32, and what the start value adds to one of k bytes."""
    one = crc_of_bytes()
    added, start = [one], [np.uint32(0xFFFFFFFF)]
    for _ in range(longest):
        added.append((added[-1] >> 8) ^ one[added[-1] & 0xFF])
        start.append((start[-1] >> np.uint32(8)) ^ one[start[-1] & np.uint32(0xFF)])
    return np.concatenate(added), np.array(start, np.uint32)


_ADDED, _START = _crc_tables(SHORT)


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each byte run [start, end), none of them empty.

    A crc32 is linear: it is the exclusive or of what each byte adds at its distance from the end.
    """
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero(end - start <= SHORT)
    if len(short):
        size = (end - start)[short].astype(np.int32)
        at = np.cumsum(size) - size
        left = np.repeat(at + size - 1, size) - np.arange(at[-1] + size[-1])  # bytes after each
        places = np.repeat(end[short] - 1, size) - left
        values = _ADDED[left * 256 + data[places]]
        out[short] = np.bitwise_xor.reduceat(values, at) ^ _START[size] ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(end - start > SHORT).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].data)
    return out


def _spaced(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space each: bytes, starts and ends."""
    size = found.end - found.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(start, size) + within] = found.data[np.repeat(found.start, size) + within]
    return data, start, end


def features(found: Words, unit: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, first word, last word) of the runs of 1, 2 ... words of one unit each; ``unit`` is that of each word."""
    n = len(found.start)
    data, start, end = (found.data, found.start, found.end) if longest == 1 else _spaced(found)
    for k in range(1, min(longest, n) + 1):
        first = np.flatnonzero(unit[: n - k + 1] == unit[k - 1 :])
        last = first + k - 1
        yield (crc32s(data, start[first], end[last]) % buckets).astype(np.int64), first, last


def _words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    return words(lowered(data), offsets, _IS_WORD)


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts the number of their lines, the distinct lines of all, and which of them each line is."""
    cut = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = cut.flatten().dictionary_encode()
    return pc.list_value_length(cut).to_numpy(zero_copy_only=False), coded.dictionary, coded.indices.to_numpy()


def _line_of(found: Words) -> np.ndarray:
    """For each word of texts a number that grows with every line feed before it and with every text."""
    feeds = np.cumsum(found.data == 0x0A)
    return (feeds[found.start] if len(found.start) else np.zeros(0, np.int64)) + found.text_of()


def feature_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket; null texts have none."""
    sent(docs.sparkSession)

    def in_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in sliced(batches, "line", NARROW_BYTES):
            found = _words(batch.column("line"))
            times = batch.column("times").to_numpy()
            line = found.text_of()
            for bucket, first, _ in features(found, line, longest, buckets):
                np.add.at(sums, bucket, times[line[first]])
        yield from _listed(sums)

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in sliced(batches, "text", NARROW_BYTES):
            found = _words(batch.column("text"))
            line = _line_of(found)
            for bucket, first, last in features(found, found.text_of(), longest, buckets):
                np.add.at(sums, bucket[line[first] != line[last]], 1)
        yield from _listed(sums)

    texts = docs.select(F.col(text_col).alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    counts = lines.mapInArrow(in_lines, "bucket long, n long")
    if longest > 1:
        counts = counts.unionByName(texts.mapInArrow(across, "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    # One row for each bucket at most.
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def _listed(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(sums)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket 1000 times the logarithm of how much likelier it is in the target, smoothed by one, floored."""
    buckets = len(source)
    of_source, of_target = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighed(
    docs: DataFrame, gain: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight), one per row of ``docs``: the mean gain of its features, floored; 0 without any."""
    shared = sent(docs.sparkSession).sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in sliced(batches, most=NARROW_BYTES):
            texts = batch.column("text")
            n_lines, distinct, line_at = _lines(texts)
            text_at = np.repeat(np.arange(len(texts)), n_lines)
            found = _words(distinct)
            line = found.text_of()
            n_words, n_features, total = found.counts, np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            for bucket, first, _ in features(found, line, longest, len(gain)):
                n_features += np.bincount(line[first], minlength=len(distinct))
                np.add.at(total, line[first], gain[bucket])
            sums = []
            for of_line in (n_words, n_features, total):
                of_text = np.zeros(len(texts), np.int64)
                np.add.at(of_text, text_at, of_line[line_at])
                sums.append(of_text)
            if longest > 1:
                found = _words(texts)
                line, text = _line_of(found), found.text_of()
                for bucket, first, last in features(found, text, longest, len(gain)):
                    cross = line[first] != line[last]
                    np.add.at(sums[1], text[first[cross]], 1)
                    np.add.at(sums[2], text[first[cross]], gain[bucket[cross]])
            n_words, n_features, total = sums
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            columns = [batch.column("doc_id"), *(pa.array(x) for x in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one per row of ``docs``.

    ``score`` is the weight plus Gumbel noise from a hash of the id, in
    thousandths.  Of the N documents of ``least_words`` words or more the
    floor(percent * N / 100) of highest score are drawn, of equal ones the
    smaller id, null ids last; ``rank`` numbers them from 1, and is null for the
    rest.  Null and empty texts have no features and weigh 0.  Rows that share an
    id are rows like others.  Without a target every gain is the smoothed one.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets are at most {MOST_BUCKETS}")
    gain = gains(feature_counts(docs, longest, buckets, text_col), feature_counts(target, longest, buckets, target_col))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000) * F.log(-F.log(u)))
    rows = weighed(docs, gain, longest, id_col, text_col)
    rows = stored(rows.withColumn("score", F.col("weight") + noise.cast("long")), "weighed")
    fit = F.col("n_words") >= least_words
    n = rows.filter(fit).count() * percent // 100
    placed = numbered(rows.filter(fit), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    rank = F.when(F.col("rank") <= n, F.col("rank"))
    kept = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*kept, rank.cast("long").alias("rank")).unionByName(
        rows.filter(~fit).select(*kept, F.lit(None).cast("long").alias("rank"))
    )


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id :func:`resampled` draws, with all their columns; rows with a null id are not among them."""
    ids = resampled(docs, target, id_col=id_col, **options).filter("rank is not null and doc_id is not null")
    ids = ids.select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, F.col(id_col).cast("long") == F.col("__drawn"), "left_semi")

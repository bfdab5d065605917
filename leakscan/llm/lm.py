"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale, and an
n-gram of level q is put into a filter under the names (n-gram, 1) to
(n-gram, q).  Probing the names in turn until one is missing reads the level
back.  The filters are sized by the training text and broadcast; what is
broadcast at a time is bounded.  Filters of more bytes are stored and broadcast
in blocks of segments, one after the other: each block is a pass over the texts
that reads the levels of the n-grams in its segments, and the levels of a slice
are added up before it is scored.

A pair's probability is mixed with its word's, and the fuller the filter of
pairs, hence the likelier a false hit, the less the pairs weigh; in the same way
a full filter of words gives way to words that are equally likely.

Besides, each text gets an exact score by word counts alone.  The most frequent
words of each segment of the key range are broadcast with their counts, so many
per segment; the others meet their counts in a shuffle of packed entries, where
no word has a large share of a segment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.llm import segments
from leakscan.llm.code import sent
from leakscan.llm.store import dropped, stored
from leakscan.llm.words import lowered, mixed, sliced, utf8, words

# The filters have so many bits for each character of training text.
WORD_BITS, PAIR_BITS = 0.3, 0.8
BLOCK_BYTES = 256 << 20  # of each filter, broadcast at a time
FREQUENT = 1024  # words of each segment whose counts are broadcast
PAIR_WEIGHT = 0.4
BLOB_KEYS = 1 << 21
STEP = 1.25
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scale() -> np.ndarray:
    """The least count of each level: 1, 2, 3, ... and then a quarter more each time."""
    out = [1]
    while out[-1] < 2**62:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out, np.int64)


LEAST = _scale()
# What a level stands for: the geometric middle of its counts; level 0 is a count of 0.
VALUE = np.concatenate([[0.0], np.sqrt(LEAST[:-1].astype(float) * (LEAST[1:] - 1))])


def _named(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys + np.asarray(level).astype(np.uint64) * _ODD)


def levels_put(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The names under which n-grams with these counts are put into a filter."""
    level = np.searchsorted(LEAST, counts, "right")
    n = np.repeat(np.arange(len(keys)), level)
    within = np.arange(len(n)) - np.repeat(np.cumsum(level) - level, level) + 1
    return _named(keys[n], within)


def levels_read(known: segments.Filter, keys: np.ndarray) -> np.ndarray:
    """Levels, by repeated probes; 0 for keys of segments that the filter does not hold."""
    level = np.zeros(len(keys), np.uint8)
    alive = np.flatnonzero(known.covers(keys))
    for probe in range(1, len(VALUE)):
        alive = alive[known.holds(_named(keys[alive], probe), keys[alive])]
        if not len(alive):
            break
        level[alive] = probe
    return level


def counts_read(known: segments.Filter, keys: np.ndarray) -> np.ndarray:
    """Approximate counts."""
    return VALUE[levels_read(known, keys)]


@dataclass
class Text:
    """Tokens of the texts of a slice: the words of each, then its end."""

    token: np.ndarray
    first: np.ndarray  # of each text, index of its first token; one more at the end

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def before(self) -> np.ndarray:
        out = np.empty_like(self.token)
        out[1:] = self.token[:-1]
        out[self.first[:-1]] = BEGIN
        return out


def tokens(column: pa.Array) -> Text:
    data, at = utf8(column)
    found = words(lowered(data), at)
    ends = found.first[1:] + np.arange(len(at) - 1)
    token = np.full(len(found.start) + len(at) - 1, END, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word] = found.hashes()
    return Text(token, np.concatenate([[0], ends + 1]))


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(before * _ODD + token)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _fields(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


COUNTED = "segment int, pair boolean, keys binary, counts binary"


def _count(count: int):
    """Blobs, by segment, of keys and counts: of words, and of pairs."""

    def blobs(held: list[tuple[np.ndarray, np.ndarray]], pair: bool) -> pa.RecordBatch:
        keys, counts = _summed(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        rows = [
            {"segment": k, "pair": pair, "keys": keys[a:b].tobytes(), "counts": counts[a:b].astype(np.uint32).tobytes()}
            for k, a, b in segments.cut(keys, count)
        ]
        return pa.RecordBatch.from_pylist(rows, _fields(COUNTED))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        for batch in sliced(batches):
            text = tokens(batch.column("text"))
            for pair, keys in ((False, text.token), (True, pairs(text.before(), text.token))):
                held[pair].append(_summed(keys, np.ones(len(keys), np.uint32)))
                if sum(len(k) for k, _ in held[pair]) >= BLOB_KEYS:
                    yield blobs(held[pair], pair)
                    held[pair] = []
        for pair in held:
            if held[pair]:
                yield blobs(held[pair], pair)

    return run


LEARNED = (
    "segment int, words binary, pairs binary, word_bits long, pair_bits long, total long, distinct long, "
    "frequent binary, times binary"
)


def _bits(blob: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(blob, np.uint8)).sum())


def _learn(word_filter: segments.Filter, pair_filter: segments.Filter):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                blob = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.uint32).astype(np.int64)
                found.setdefault((r["segment"], r["pair"]), []).append(blob)
        for k in {k for k, _ in found}:
            none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            sums = [_summed(*(np.concatenate(x) for x in zip(*found.pop((k, p), none)))) for p in (False, True)]
            (keys, counts), (pair_keys, pair_counts) = sums
            top = np.argsort(-counts, kind="stable")[:FREQUENT]
            own, own_pairs = word_filter.one(levels_put(keys, counts)), pair_filter.one(levels_put(pair_keys, pair_counts))
            row = {
                "segment": k,
                "words": own,
                "pairs": own_pairs,
                "word_bits": _bits(own),
                "pair_bits": _bits(own_pairs),
                "total": int(counts.sum()),
                "distinct": len(keys),
                "frequent": keys[top].tobytes(),
                "times": counts[top].tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], _fields(LEARNED))

    return run


class Model:
    """Filters of words and pairs, totals, and exact counts of the frequent words.

    The filters are empty where they are broadcast in blocks.
    """

    def __init__(self, count: int, word_bytes: int, pair_bytes: int):
        self.count = count
        self.words = segments.Filter(count, word_bytes)
        self.pairs = segments.Filter(count, pair_bytes)
        self.total = self.distinct = self.texts = 0
        self.frequent, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.whole = True

    def learned(self, rows: Iterable, texts: int, whole: bool) -> Model:
        if whole:
            for f in (self.words, self.pairs):
                f.filled(())
        frequent, times, bits = [self.frequent], [self.times], np.zeros(2, np.int64)
        for r in rows:
            if whole:
                for f, name in ((self.words, "words"), (self.pairs, "pairs")):
                    f.bytes[r.segment * f.size : (r.segment + 1) * f.size] = np.frombuffer(r[name], np.uint8)
            self.total += r.total
            self.distinct += r.distinct
            bits += (r.word_bits, r.pair_bits)
            frequent.append(np.frombuffer(r.frequent, np.uint64))
            times.append(np.frombuffer(r.times, np.int64))
        keys, counts = np.concatenate(frequent), np.concatenate(times)
        order = np.argsort(keys)
        self.frequent, self.times, self.texts, self.whole = keys[order], counts[order], texts, whole
        # A false hit at the first name of an n-gram is as likely as finding all its probes set.
        fills = (float(n) / (8 * self.count * f.size) for n, f in zip(bits, (self.words, self.pairs)))
        self.word_error, self.error = (fill**segments.PROBES for fill in fills)
        return self

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def exact(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is a frequent word, and its count if so."""
        if not len(self.frequent):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return self.frequent[at] == keys, self.times[at]

    def log_probabilities(self, words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before it, by the levels of both; see :func:`levels`."""
        counts = np.minimum(VALUE[words], self.total)
        contexts = np.empty_like(counts)
        contexts[1:] = counts[:-1]
        contexts[first[:-1]] = self.texts
        both = np.minimum(VALUE[pairs], np.minimum(contexts, counts))
        weight = PAIR_WEIGHT * (1 - self.error) * (contexts > 0)
        after = np.divide(both, contexts, out=np.zeros_like(both), where=contexts > 0)
        alone = (1 - self.word_error) * (counts + 0.5) / self.mass + self.word_error / (self.distinct + 1)
        return np.log10(weight * after + (1 - weight) * alone)

    def summed(self, words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of each text."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return np.bincount(row, self.log_probabilities(words, pairs, first), len(first) - 1).astype(float)


def levels(text: Text, word_filter: segments.Filter, pair_filter: segments.Filter) -> tuple[np.ndarray, np.ndarray]:
    """For each token its level as a word, and that of its pair with the one before."""
    names, inverse = np.unique(text.token, return_inverse=True)
    return levels_read(word_filter, names)[inverse], levels_read(pair_filter, pairs(text.before(), text.token))


def _probe(block: Broadcast):
    """For each slice the levels that the segments of one block give."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(sliced(batches)):
            text = tokens(batch.column("text"))
            words_, pairs_ = levels(text, *block.value)
            row = {"slice": (part << 32) + number, "words": words_.tobytes(), "pairs": pairs_.tobytes(), "check": _check(text)}
            yield pa.RecordBatch.from_pylist([row], _fields(LEVELS))

    return run


def _check(text: Text) -> int:
    """A sum over the tokens of a slice and their places: passes must see the same slices."""
    with np.errstate(over="ignore"):
        places = np.arange(len(text.token), dtype=np.uint64) * _ODD
        return int(mixed(text.token + places).sum(dtype=np.uint64).view(np.int64))


def train(
    docs: DataFrame,
    text_col: str = "text",
    word_bytes: int | None = None,
    pair_bytes: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[Broadcast, DataFrame | None, list[tuple[int, int]]]:
    """The model of all rows of ``docs``, broadcast; a null text is an empty one.

    Where filters take more than ``block_bytes`` they are in a stored table, to
    be broadcast for one range of segments after the other; otherwise there is
    no such table.
    """
    spark = sent(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"))
    texts, size = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    sizes = ((WORD_BITS, word_bytes), (PAIR_BITS, pair_bytes))
    sizes = [segments.filter_bytes(size, bits, most) for bits, most in sizes]
    # So many segments that a block has room for one.
    count = max(1, segments.segments_of(spark) // 4, *(-(-n // block_bytes) for n in sizes))
    model = Model(count, *sizes)
    step = max(1, min(count, *(block_bytes // f.size for f in (model.words, model.pairs))))
    blocks = [(a, min(a + step, count)) for a in range(0, count, step)]
    blobs = rows.mapInArrow(_count(count), COUNTED).repartition(count, "segment")
    learned = blobs.mapInArrow(_learn(model.words, model.pairs), LEARNED)
    whole = max(sizes) <= block_bytes
    if not whole:
        learned = stored(learned, "learned")
    read = learned if whole else learned.drop("words", "pairs")
    known = spark.sparkContext.broadcast(model.learned(read.toLocalIterator(), texts, whole))
    return known, None if whole else learned, blocks


def levels_of(rows: DataFrame, model: Model, learned: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """Rows (slice, words, pairs, check) of the slices of ``rows``, for each block of segments."""
    out = None
    for a, b in blocks:
        filters = [segments.Filter(model.count, f.size * model.count, a, b).filled(()) for f in (model.words, model.pairs)]
        for r in learned.filter((F.col("segment") >= a) & (F.col("segment") < b)).select("segment", "words", "pairs").toLocalIterator():
            for f, blob in zip(filters, (r.words, r.pairs)):
                f.bytes[(r.segment - a) * f.size : (r.segment - a + 1) * f.size] = np.frombuffer(blob, np.uint8)
        block = rows.sparkSession.sparkContext.broadcast(tuple(filters))
        found = stored(rows.mapInArrow(_probe(block), LEVELS), "levels")
        block.destroy()
        out = found if out is None else out.unionByName(found)
    return out


ENTRIES = (
    "segment int, slice long, ids binary, nulls binary, train binary, tokens binary, known binary, base binary, "
    "score binary, check long, row binary, key binary, times binary"
)
SUMS = "slice long, ids binary, nulls binary, train binary, tokens binary, known binary, base binary, score binary, check long"
LEVELS = "slice long, words binary, pairs binary, check long"
SCORED = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def _score(known: Broadcast):
    """For each slice one row with what is known of its texts, and blobs of the other words by segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = known.value
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(sliced(batches)):
            text = tokens(batch.column("text"))
            row, n = text.row, batch.num_rows
            frequent, counts = model.exact(text.token)
            base = np.log10((counts[frequent] + 0.5) / model.mass)
            ids = batch.column("doc_id")
            train = batch.column("learned").to_numpy(zero_copy_only=False)
            name = (part << 32) + number
            head = {
                "segment": name % model.count,
                "slice": name,
                "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                "nulls": np.asarray(ids.is_null()).tobytes(),
                "train": train.astype(bool).tobytes(),
                "tokens": np.diff(text.first).astype(np.int64).tobytes(),
                "known": np.bincount(row[frequent], minlength=n).astype(np.int64).tobytes(),
                "base": np.bincount(row[frequent], base, n).astype(float).tobytes(),
                "score": model.summed(*levels(text, model.words, model.pairs), text.first).tobytes() if model.whole else None,
                "check": None if model.whole else _check(text),
            }
            # The other words, once for each text, in order of their key.
            keys, of = text.token[~frequent], row[~frequent]
            order = np.lexsort((of, keys))
            keys, of = keys[order], of[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys, of = keys[first], of[first].astype(np.uint32)
            rows = [head]
            for k, a, b in segments.cut(keys, model.count):
                blob = {"row": of[a:b].tobytes(), "key": keys[a:b].tobytes(), "times": times[a:b].tobytes()}
                rows.append({"segment": k, "slice": name, "train": head["train"]} | blob)
            yield pa.RecordBatch.from_pylist(rows, _fields(ENTRIES))

    return run


def _meet(known: Broadcast):
    """Words meet their counts: for each slice and segment the sums of its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = known.value.mass
        found: dict[int, list[tuple]] = {}
        heads: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["ids"] is not None:
                    heads.append({name: r[name] for name in _fields(SUMS).names})
                    continue
                keys, row = np.frombuffer(r["key"], np.uint64), np.frombuffer(r["row"], np.uint32)
                found.setdefault(r["segment"], []).append(
                    (r["slice"], np.frombuffer(r["train"], bool), row, keys, np.frombuffer(r["times"], np.uint32))
                )
        yield pa.RecordBatch.from_pylist(heads, _fields(SUMS))
        for blobs in found.values():
            learned = [(k[t[r]], n[t[r]].astype(np.int64)) for _, t, r, k, n in blobs]
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*learned)))
            rows = []
            for name, train, row, own, times in blobs:
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                c = np.where(keys[at] == own, counts[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                base = np.bincount(row, times * np.log10((c + 0.5) / mass), len(train)).astype(np.float64)
                seen = np.bincount(row, times * (c > 0), len(train)).astype(np.int64)
                rows.append({"slice": name, "known": seen.tobytes(), "base": base.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _fields(SUMS))

    return run


def _sum(known: Broadcast):
    """The sums of each slice; of its levels as well, which make its score, where blocks read them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, dict] = {}
        sums: dict[int, list[np.ndarray]] = {}
        read: dict[int, list[np.ndarray]] = {}
        checks: dict[int, set[int]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["check"] is not None:
                    checks.setdefault(r["slice"], set()).add(r["check"])
                if r.get("words") is not None:
                    own, into = [np.frombuffer(r[name], np.uint8) for name in ("words", "pairs")], read
                else:
                    if r["ids"] is not None:
                        heads[r["slice"]] = r
                    own, into = [np.frombuffer(r["known"], np.int64), np.frombuffer(r["base"], np.float64)], sums
                before = into.get(r["slice"])
                into[r["slice"]] = own if before is None else [a + b for a, b in zip(before, own)]
        if any(len(c) > 1 for c in checks.values()):
            raise RuntimeError("the passes over the texts saw different slices")
        for name, r in heads.items():
            seen, base = sums[name]
            counts = np.frombuffer(r["tokens"], np.int64)
            if r["score"] is None:
                score = known.value.summed(*read.pop(name), np.concatenate([[0], np.cumsum(counts)]))
            else:
                score = np.frombuffer(r["score"], np.float64)
            columns = [
                pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["nulls"], bool)),
                pa.array(np.frombuffer(r["train"], bool)),
                pa.array(counts),
                pa.array(seen),
                pa.array(base),
                pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORED.split(", ")])

    return run


def scores(
    docs: DataFrame,
    learned: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_bytes: int | None = None,
    pair_bytes: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``, learning from those where ``learned`` is true.

    Columns: doc_id, learned, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (exact, by word counts alone) and score (by the
    filters), both log10.  Letters A-Z are lowered; tokens are runs other than
    space and \\x09-\\x0D, and one end.  Null and empty texts have the end only.
    Rows are scored one by one, so ids may be null or repeat; a null ``learned``
    is false.  With no training row all counts are 0 and every token is
    equally likely.  The filters grow with the training text, to ``word_bytes``
    and ``pair_bytes`` if given; ``block_bytes`` of each are broadcast at a time,
    and each block after the first reads the texts once more.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(learned, F.lit(False)).alias("learned"),
    )
    model, filters, blocks = train(rows.filter("learned"), "text", word_bytes, pair_bytes, block_bytes)
    count = model.value.count
    if filters is not None:
        rows = stored(rows, "texts")  # so that all passes see the same slices
    met = rows.mapInArrow(_score(model), ENTRIES).repartition(count, "segment").mapInArrow(_meet(model), SUMS)
    if filters is not None:
        met = met.unionByName(levels_of(rows, model.value, filters, blocks), allowMissingColumns=True)
        dropped(filters)
    out = met.repartition(count, "slice").mapInArrow(_sum(model), SCORED)
    return out.withColumn("train_tokens", F.lit(model.value.total).cast("long"))

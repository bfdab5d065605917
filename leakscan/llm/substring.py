"""Substring dedup: repeated runs of words, found length by length.

Windows are first looked for at half the wanted length.  Only where such a
short window occurs in two rows are windows of the wanted length formed; only
those that repeat are extended to twice that length, four times and so on.  A
longer window repeats only if every window inside it does, so it is looked at
only where windows that repeat start at one word after the other.

The short windows are sampled by content: of those inside each wanted window
the one with the smallest hash stands for it, so equal windows choose equal
representatives, and a wanted window that repeats has one that repeats.  The
representatives that repeat are put into a filter of fixed size; were it ever
full, more windows would be compared, and the result would be the same.

Of equal texts only the first takes part; the others are cut whole.  A filter of
ids tells texts apart that must be met with their removals, in a shuffle, from
the rest, which pass as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.llm import segments
from leakscan.llm.code import sent
from leakscan.llm.store import dropped, stored
from leakscan.llm.words import NARROW_BYTES, Words, mixed, sliced, utf8, whole_windows, windows, words

WINDOW = 13
FILTER_BYTES = 256 << 20  # at most; smaller ones for smaller inputs
BITS_PER_CHARACTER = 0.2
BLOB_KEYS = 1 << 21


def _representatives(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window start, the smallest hash of the half-length windows inside it."""
    half = (window + 1) // 2
    short = windows(hashes, half)
    n = len(hashes) - window + 1
    out = short[:n].copy()
    for k in range(1, window - half + 1):
        np.minimum(out, short[k : k + n], out=out)
    return out


def _first_texts(batches: Iterable[pa.RecordBatch], firsts) -> Iterator[pa.RecordBatch]:
    """Slices of the batches without most of the rows that repeat an earlier text."""
    for batch in sliced(batches, most=NARROW_BYTES):
        yield batch.filter(pa.array(segments.maybe(firsts.value, batch.column("key"))))


def _short_windows(window: int, count: int, firsts):
    """Blobs, by segment, of representatives; the last bit tells that two rows of the task have it."""

    def blobs(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(parts))
        names = keys | np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        many = np.diff(np.append(first, len(keys))) > 1
        keys = (keys[first] & ~np.uint64(1)) | (many | ((keys[np.append(first[1:], len(keys)) - 1] & np.uint64(1)) == 1))
        return segments.packed(keys, count)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in _first_texts(batches, firsts):
            found = words(*utf8(batch.column("text")))
            hashes = found.hashes()
            if len(hashes) < window:
                continue
            names = _representatives(hashes, window)
            whole = whole_windows(found.first, window, len(names))
            row = found.text_of()[: len(names)][whole]
            names = names[whole] & ~np.uint64(1)
            order = np.lexsort((row, names))
            names, row = names[order], row[order]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
            held.append(names[new])
            if sum(map(len, held)) >= BLOB_KEYS:
                yield blobs(held)
                held = []
        if sum(map(len, held)):
            yield blobs(held)

    return run


def _repeated(keys: np.ndarray) -> np.ndarray:
    """The representatives that two rows have."""
    keys = np.sort(keys)
    twice = (keys & np.uint64(1)) == 1
    twice[1:] |= (keys[1:] | np.uint64(1)) == (keys[:-1] | np.uint64(1))
    return keys[twice] & ~np.uint64(1)


def _twice(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows twice as long as those of ``left``, each of which ends where that of ``right`` starts."""
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F))


def _checks(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A second hash, of 32 bits, of the windows that start at the given words."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            out = (out + mixed(hashes[at + k])) * np.uint64(0x9FB21C651E98DF25)
    return (mixed(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _candidates(window: int, known, firsts):
    """Rows (doc_id, t, pos, h, g) of the windows whose representative may repeat; h and g are independent hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_texts(batches, firsts):
            found = words(*utf8(batch.column("text")))
            hashes = found.hashes()
            if len(hashes) < window:
                continue
            names = _representatives(hashes, window) & ~np.uint64(1)
            whole = np.flatnonzero(whole_windows(found.first, window, len(names)))
            at = whole[known.value.holds(names[whole])]
            level = windows(hashes, window)
            h = level[at]
            row = found.text_of()[at]
            take = pa.array(row)
            columns = [
                batch.column("doc_id").take(take),
                batch.column("t").take(take),
                pa.array((at - found.first[row]).astype(np.int32)),
                pa.array(h.view(np.int64)),
                pa.array(_checks(hashes, at, window)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "pos", "h", "g"])

    return run


def _names(text_col: str) -> list[Column]:
    """Two hashes and the characters of a text, by which equal texts meet."""
    text = F.coalesce(text_col, F.lit(""))
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.length(text).alias("n")]


def first_texts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n) of rows (doc_id, text): of each text the smallest id that has it, and its characters."""
    keys = docs.select("doc_id", *_names("text"))
    firsts = keys.groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id"))
    return stored(firsts.groupBy("doc_id").agg(F.sum("n").alias("n")), "firsts")


def repeated_windows(docs: DataFrame, firsts: DataFrame, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """Windows that may repeat, of rows (doc_id, text) without null ids: (doc_id, t, pos, h, g).

    Every window whose word sequence is in two documents of ``firsts`` is
    there; ``t`` tells the texts of a document apart.
    """
    spark = sent(docs.sparkSession)
    most = FILTER_BYTES if most is None else most
    count = segments.segments_of(spark)
    size = segments.filter_bytes(firsts.agg(F.sum("n")).first()[0], BITS_PER_CHARACTER, most)
    first = segments.id_filter(firsts, count, most)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"), F.hash("text").alias("t"))
    short = rows.mapInArrow(_short_windows(window, count, first), segments.PACKED)
    known = segments.broadcast_filter(short, count, size, _repeated)
    schema = "doc_id long, t int, pos int, h long, g int"
    found = stored(rows.mapInArrow(_candidates(window, known, first), schema), "windows")
    for used in (known, first):
        used.destroy()
    return found


def _in_two(rows: DataFrame) -> DataFrame:
    ids = rows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return stored(ids.filter("least < most").select("h", "g", "least"), "repeated")


SHARED = np.uint32(2**32 - 1)  # in place of its document, for a key that several of a blob have
LONGER = pa.schema([("segment", pa.int32()), ("keys", pa.binary()), ("level", pa.binary()), ("of", pa.binary()), ("ids", pa.binary())])
LONGER_SQL = "segment int, keys binary, level binary, of binary, ids binary"
LONGEST = pa.schema([("doc_id", pa.int64()), ("longest", pa.int64())])
LONGEST_SQL = "doc_id long, longest long"
ANSWER = pa.schema([("segment", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary())])
ANSWER_SQL = "segment int, ids binary, sizes binary"


def _longest(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and for each the greatest of its sizes."""
    order = np.lexsort((-sizes, ids))
    ids, sizes = ids[order], sizes[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return ids[new], sizes[new]


def _longer(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, row of the batch, level) of the windows of 2, 4 ... times the length that may repeat."""
    place = batch.column("places").flatten().to_numpy(zero_copy_only=False) >> 1
    level = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("places")).to_numpy(zero_copy_only=False))
    order = np.lexsort((place, row))
    place, level, row = place[order], level[order], row[order]
    new = np.ones(len(row), bool)  # rows of a document with the same text say the same
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    place, level, row = place[new], level[new], row[new]
    breaks = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    edges = np.concatenate([[0], breaks, [len(row)]])
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(row))  # windows from here to the end of the run
    size, number = window, 0
    while True:
        at = np.flatnonzero(left >= 2 * size - window + 1)
        if not len(at):
            return
        longer = np.zeros_like(level)
        longer[at] = _twice(level[at], level[at + size])
        level, size, number = longer, 2 * size, number + 1
        yield level[at], row[at], number


def _followed(window: int, count: int):
    """Blobs, by segment, of the longer windows of documents with (doc_id, places, hashes).

    A key leaves with its document, or once for all documents of a blob.
    """

    def blobs(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids, level = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((ids, keys))
        keys, ids, level = keys[order], ids[order], level[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.append(first[1:], len(keys)) - 1
        shared = ids[first] != ids[last]
        several = np.repeat(shared, last - first + 1)
        # Documents of a shared key are sent on as a key of their own: one for each document and level.
        own, own_level = ids[several], level[several]
        keys, owner, level = keys[first], ids[first], level[first]
        rows = []
        for k, a, b in segments.cut(keys, count):
            names, of = np.unique(owner[a:b], return_inverse=True)
            of = np.where(shared[a:b], SHARED, of.astype(np.uint32))
            rows.append({
                "segment": k, "keys": keys[a:b].tobytes(), "level": level[a:b].tobytes(),
                "of": of.tobytes(), "ids": names.tobytes(),
            })
        if len(own):
            names, most = _longest(own, own_level.astype(np.int64))
            place = int(segments.segment(mixed(names[:1].view(np.uint64)), count)[0])
            rows.append({"segment": place, "level": most.astype(np.uint8).tobytes(), "ids": names.tobytes()})
        return pa.RecordBatch.from_pylist(rows, LONGER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for keys, row, number in _longer(batch, window):
                held.append((keys, ids[row], np.full(len(keys), number, np.uint8)))
                if sum(len(h[0]) for h in held) >= BLOB_KEYS:
                    yield blobs(held)
                    held = []
        if held:
            yield blobs(held)

    return run


def _met(window: int, count: int):
    """Blobs, by segment of the id, of documents whose longer windows are in another one too, with the longest."""

    def blobs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes = _longest(*(np.concatenate(x) for x in zip(*held)))
        keys = mixed(ids.view(np.uint64))
        order = np.argsort(keys)
        keys, ids, sizes = keys[order], ids[order], sizes[order]
        rows = [{"segment": k, "ids": ids[a:b].tobytes(), "sizes": sizes[a:b].tobytes()} for k, a, b in segments.cut(keys, count)]
        return pa.RecordBatch.from_pylist(rows, ANSWER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for r in batch.to_pylist():
                ids, level = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["level"], np.uint8)
                if r["keys"] is None:
                    held.append((ids, np.int64(window) << level.astype(np.int64)))
                    continue
                of = np.frombuffer(r["of"], np.uint32)
                shared = of == SHARED
                owner = ids[np.where(shared, 0, of)]
                found.setdefault(r["segment"], []).append((np.frombuffer(r["keys"], np.uint64), owner, level, shared))
        for k in list(found):
            keys, owner, level, shared = (np.concatenate(x) for x in zip(*found.pop(k)))
            order = np.argsort(keys, kind="stable")
            keys, owner, level, shared = keys[order], owner[order], level[order], shared[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
            many = (least < most) | np.logical_or.reduceat(shared, first)
            hit = np.repeat(many, np.diff(np.append(first, len(keys)))) & ~shared
            held.append(_longest(owner[hit], np.int64(window) << level[hit].astype(np.int64)))
            if sum(len(ids) for ids, _ in held) >= BLOB_KEYS:
                yield blobs(held)
                held = []
        if held:
            yield blobs(held)

    return run


def _answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of a segment once, with its longest."""
    for blobs in segments.gathered(batches).values():
        found = [(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)) for ids, sizes in blobs]
        ids, sizes = _longest(*(np.concatenate(x) for x in zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes)], schema=LONGEST)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of each text the number of its words."""
    for batch in sliced(batches, most=NARROW_BYTES):
        counts = pa.array(words(*utf8(batch.column("text"))).counts.astype(np.int64))
        rest = [batch.column(c) for c in ("doc_id", "a", "b", "n")]
        yield pa.RecordBatch.from_arrays([*rest, counts], ["doc_id", "a", "b", "n", "words"])


def whole_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, longest): the words of the longest text of ``window`` or more that another document has as well."""
    named = docs.select("doc_id", "text", *_names("text"))
    keys = stored(named.mapInArrow(_counted, "doc_id long, a long, b long, n int, words long").filter(F.col("words") >= window), "keys")
    firsts = keys.groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") < F.max("doc_id")).alias("many"))
    # By document as well, so that a text with many copies does not meet in one task.
    met = keys.join(firsts, ["doc_id", "a", "b", "n"], "left").filter("many is null or many")
    return met.groupBy("doc_id").agg(F.max("words").alias("longest"))


def longest_repeats(runs: DataFrame, whole: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, longest): the longest window of ``window`` words, twice, four times ... that two documents have.

    ``runs`` has (doc_id, places, hashes) of all windows of ``window`` words that
    repeat, and ``whole`` the lengths of texts that repeat as a whole.
    """
    count = segments.segments_of(runs.sparkSession)
    blobs = runs.mapInArrow(_followed(window, count), LONGER_SQL).repartition(max(1, count // 4), "segment")
    every = runs.select("doc_id", F.lit(window).cast("long").alias("longest")).unionByName(whole)
    answers = blobs.mapInArrow(_met(window, count), ANSWER_SQL).repartition(max(1, count // 4), "segment")
    every = every.unionByName(answers.mapInArrow(_answered, LONGEST_SQL))
    return stored(every.groupBy("doc_id").agg(F.max("longest").alias("longest")), "longest")


def removals(docs: DataFrame, window: int = WINDOW, follow: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc_id, starts, copy): where windows start that a smaller doc_id has too.

    ``copy`` is true, and starts null, where the whole text is one of a smaller
    doc_id.  With ``follow`` rows (doc_id, longest) as well, see :func:`longest_repeats`.
    """
    firsts = first_texts(docs)
    found = repeated_windows(docs, firsts, window)
    first = _in_two(found)
    met = found.join(first, ["h", "g"])
    longest = None
    if follow:
        later = (F.col("doc_id") > F.col("least")).cast("long")
        place = F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(later)
        runs = met.groupBy("doc_id").agg(F.collect_list(place).alias("places"), F.collect_list("h").alias("hashes"))
        runs = stored(runs, "runs")
        own = F.filter("places", lambda p: p.bitwiseAND(F.lit(1)) == 1)
        pos = F.transform(own, lambda p: F.shiftright(p.bitwiseAND(F.lit(2**32 - 1)), 1).cast("int"))
        starts = runs.select("doc_id", pos.alias("starts")).filter(F.size("starts") > 0)
        longest = longest_repeats(runs, whole_repeats(docs, window), window)
    else:
        starts = stored(met.filter("doc_id > least").groupBy("doc_id").agg(F.collect_list("pos").alias("starts")), "starts")
    # The filter lets a few copies through: they have starts as well, which say less.
    copies = docs.select("doc_id").distinct().join(firsts, "doc_id", "left_anti")
    out = starts.join(firsts, "doc_id", "left_semi").select("doc_id", "starts", F.lit(False).alias("copy"))
    none = [F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")]
    kept = stored(out.unionByName(copies.select("doc_id", *none)), "removals")
    dropped(found)
    return kept, longest


def _kept(found: Words, batch: pa.RecordBatch, window: int) -> np.ndarray:
    """For each word of the slice, whether no removed window covers it."""
    change = np.zeros(len(found.start) + window + 1, np.int64)
    starts = batch.column("starts")
    at = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = at + window <= found.counts[row]  # rows that share an id may be shorter
    at = at[ok] + found.first[row[ok]]
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    copy = pc.fill_null(batch.column("copy"), False).to_numpy(zero_copy_only=False) & (found.counts >= window)
    return (np.cumsum(change)[: len(found.start)] == 0) & ~copy[found.text_of()]


def _texts(batch: pa.RecordBatch, found: Words, kept: np.ndarray) -> pa.Array:
    """Each text without its removed words; white space before a kept word stays with it."""
    _, offsets = utf8(batch.column("text"))
    data, out = found.data.tobytes(), []
    for row, text in enumerate(batch.column("text").to_pylist()):
        a, b = int(found.first[row]), int(found.first[row + 1])
        if text is None or kept[a:b].all():
            out.append(text)
            continue
        ends = np.concatenate([offsets[row : row + 1], found.end[a:b]])
        pieces = [data[ends[k] : ends[k + 1]] for k in np.flatnonzero(kept[a:b]).tolist()]
        out.append(b"".join(pieces).strip(b" \t\n\r\x0b\x0c").decode())
    return pa.array(out, pa.string())


def applied(docs: DataFrame, found: DataFrame, schema: str, emit, window: int = WINDOW) -> DataFrame:
    """Meet each text of ``docs`` with its removals and let ``emit`` make rows of a slice.

    ``docs`` has doc_id and text; only texts that may have removals are shuffled.
    """
    spark = docs.sparkSession
    known = segments.id_filter(found.select("doc_id"), segments.segments_of(spark), FILTER_BYTES)
    keyed = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.lit(0)))

    def split(batch: pa.RecordBatch) -> np.ndarray:
        return segments.maybe(known.value, batch.column("key"))

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=NARROW_BYTES):
            yield batch.filter(pa.array(split(batch)))

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=NARROW_BYTES):
            rest = batch.filter(pa.array(~split(batch)))
            got = words(*utf8(rest.column("text")))
            yield emit(rest, got, np.ones(len(got.start), bool))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=NARROW_BYTES):
            got = words(*utf8(batch.column("text")))
            yield emit(batch, got, _kept(got, batch, window))

    met = keyed.mapInArrow(some, keyed.schema).join(found, "doc_id", "left").mapInArrow(run, schema)
    return met.unionByName(keyed.mapInArrow(others, schema))


def _sums(found: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([[0], np.cumsum(~kept)])
    return found.counts, total[found.first[1:]] - total[found.first[:-1]]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, longest_repeat), one per row of ``docs``; see :func:`dedup`.

    longest_repeat is the greatest of 13, 26, 52 ... words that the document has
    in a row with another one, or the words of its text, if another has all of it.
    """

    def emit(batch, found, kept):
        n, gone = _sums(found, kept)
        texts = _texts(batch, found, kept).to_pylist()
        hashes = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
        columns = [batch.column("doc_id"), pa.array(n), pa.array(gone), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, longest = removals(rows.filter("doc_id is not null"), window, follow=True)
    out = applied(rows, found, "doc_id long, n_words long, n_removed long, kept_sha256 string", emit, window)
    return out.join(longest.withColumnRenamed("longest", "longest_repeat"), "doc_id", "left").fillna(0, ["longest_repeat"])


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    removed_col: str | None = None,
) -> DataFrame:
    """``docs`` with every word cut that lies in a repeated window of ``window`` words.

    A window is repeated when its word sequence also starts in a document with
    a smaller id, judged on the texts as they come.  A word is a run of
    characters other than space and \\x09-\\x0D, unchanged.  Null texts stay
    null, texts with fewer words stay as they are, and so do rows with a null
    id, which count for nothing.  Rows that share an id are one document: they
    never cut each other, and a place cut in one is cut in all that are long
    enough.  All columns are kept, in order, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rest = F.struct(*[c for c in plain.columns if c != text]).alias("rest")
    rows = plain.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), rest)
    found, _ = removals(rows.select("doc_id", "text").filter("doc_id is not null"), window)

    def emit(batch, found_words, kept):
        columns = [batch.column("rest"), _texts(batch, found_words, kept), pa.array(_sums(found_words, kept)[1])]
        return pa.RecordBatch.from_arrays(columns, ["rest", "text", "removed"])

    schema = f"rest {rows.schema['rest'].dataType.simpleString()}, text string, removed long"
    out = applied(rows, found, schema, emit, window)
    columns = [F.col("text") if c == text else F.col("rest")[c] for c in plain.columns]
    added = [F.col("removed").alias(removed_col)] if removed_col else []
    return out.select(*[c.alias(n) for c, n in zip(columns, names)], *added)

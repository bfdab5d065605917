"""Language identification by error-correcting output codes.

Each language has a codeword.  One binary classifier per bit, over hashed byte
n-grams, tells the languages whose codeword has the bit from the others; the
codeword with the least loss over all bits names the language.  The classifiers
are weighed from n-gram counts of all training rows, summed by Spark; only a
table of languages times buckets, both bounded, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.llm.code import sent
from leakscan.llm.words import sliced, utf8

GRAM = 3
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SLICE = 2 << 20  # bytes of text at a time: n-grams take some forty times as much
MOST_LANGUAGES = 1000  # bounds the codebook and the table of counts
UNKNOWN = "und"
TEMPERATURE = 8.0
AMBIGUOUS = 0.6

# Bytes as the n-grams see them: letters and bytes of longer characters as they are, anything else a space.
_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language, rows far apart.

    Up to seven languages have all ways to split them in two as bits; more
    have the best of some random codes, of 15 bits per doubling.
    """
    if count < 2:
        return np.ones((count, 1), np.int8)
    if count <= 7:
        bits = np.arange(1, 2 ** (count - 1))
        rows = np.stack([np.zeros(len(bits), np.int64), *((bits >> k) & 1 for k in range(count - 1))])
        return (1 - 2 * rows).astype(np.int8)
    random = np.random.default_rng(seed)
    size = int(15 * np.ceil(np.log2(count)))
    best, distance = None, -1
    for _ in range(20):
        code = random.choice(np.array([-1, 1], np.int8), (count, size))
        code = code[:, np.abs(code.sum(axis=0)) < count]
        products = code.astype(np.int32) @ code.T
        np.fill_diagonal(products, -size)
        least = int((code.shape[1] - products.max()) // 2)
        if least > distance:
            best, distance = code, least
    return best


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, and where each text's begin (one more at the end)."""
    data, at = utf8(pc.utf8_lower(batch.column("text")))
    data = _FOLDED[data]
    # Of a run of spaces only the first counts.
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    if len(data):
        keep[at[:-1][np.diff(at) > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    data, at = data[keep].astype(np.uint32), before[at]
    n = max(0, len(data) - GRAM + 1)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k : k + n]
    # Three bytes are spread over the buckets by the top bits of a product.
    buckets = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    # An n-gram that reaches into the next text is none.
    begins, ends = np.minimum(at[:-1], n), np.minimum(np.maximum(at[1:] - GRAM + 1, at[:-1]), n)
    sizes = ends - begins
    inside = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return buckets[inside], np.concatenate([[0], np.cumsum(sizes)])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in sliced(batches, most=SLICE):
        buckets, at = grams(batch)
        names = batch.column("lang").to_numpy(zero_copy_only=False)
        for name in set(names.tolist()):
            of = np.repeat(names == name, np.diff(at))
            if name not in totals:
                totals[name] = np.zeros(BUCKETS, np.int64)
            totals[name] += np.bincount(buckets[of], minlength=BUCKETS)
        if len(totals) * BUCKETS > 1 << 23:
            yield from _rows(totals)
            totals = {}
    yield from _rows(totals)


def _rows(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in totals.items():
        bucket = np.flatnonzero(counts)
        columns = [pa.array([name] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])


class Model:
    """Languages, their codewords, and a weight for each bucket and bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        # Languages weigh the same, however many texts they have.
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.weights = np.zeros((self.code.shape[1], BUCKETS), np.float32)
        for bit in range(self.code.shape[1]):
            one = self.code[:, bit] > 0
            if one.any() and not one.all():
                self.weights[bit] = np.log(share[one].mean(axis=0) / share[~one].mean(axis=0))

    def predict(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The index of the language of each text, and its score."""
        buckets, at = grams(batch)
        votes = np.zeros((len(at) - 1, self.code.shape[1]))
        if len(buckets):
            full = np.flatnonzero(np.diff(at))
            for bit, weights in enumerate(self.weights):
                votes[full, bit] = np.add.reduceat(weights[buckets], at[full], dtype=np.float64)
        margins = np.clip(votes / TEMPERATURE, -20, 20)
        loss = np.stack([np.logaddexp(0, -margins * word).sum(axis=1) for word in self.code], axis=1)
        likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), likely.max(axis=1) / likely.sum(axis=1)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from all rows with a text and a language; rows without either are not used."""
    sent(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = rows.filter("text is not null and lang is not null").mapInArrow(_count, "lang string, bucket int, n long")
    # Split by bucket too, so that no task holds a language.
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = table.groupBy("lang", F.expr("bucket % 16").alias("part")).agg(
        F.collect_list(F.struct("bucket", "n")).alias("cells")
    )
    found = packed.limit(MOST_LANGUAGES * 16 + 1).collect()
    if len(found) > MOST_LANGUAGES * 16:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted({r.lang for r in found})
    counts = np.zeros((len(languages), BUCKETS))
    for r in found:
        counts[languages.index(r.lang), [c.bucket for c in r.cells]] = [c.n for c in r.cells]
    return Model(languages, counts)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous appended, columns of these names replaced.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text when nothing was learned.  A text with letters but no known n-gram
    gets the first of the languages that tie, with a low score.  ``ambiguous``
    tells that the nearest codeword has less than 0.6 of the likelihood of all.
    Rows are judged one by one, whatever their id; other columns stay.
    """
    known = sent(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*known.value.languages, UNKNOWN])
        for batch in sliced(batches, most=SLICE):
            if len(names) == 1:
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            else:
                best, score = known.value.predict(batch)
            none = ~batch.column("lettered").to_numpy(zero_copy_only=False)
            best[none], score[none] = len(names) - 1, 0.0
            found = [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            columns = [batch.column("row"), batch.column("text"), *found]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "lang_pred", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    place = {n: f"c{k}" for k, n in enumerate(docs.columns)}
    text = F.col(place[text_col])
    # The text goes to the worker and back once, beside the other columns.
    others = [place[n] for n in names if n != text_col] or [F.lit(0).alias("none")]
    rows = plain.select(F.struct(*others).alias("row"), text.alias("text"), has_letter(text).alias("lettered"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double"
    out = rows.mapInArrow(run, schema)
    return out.select(
        *[F.col("text" if n == text_col else f"row.{place[n]}").alias(n) for n in names],
        "lang_pred",
        "score",
        ((F.col("lang_pred") != UNKNOWN) & (F.col("score") < AMBIGUOUS)).alias("ambiguous"),
    )

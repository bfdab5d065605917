"""A quality classifier: regularised quadratic discriminant analysis.

Each text becomes a row of transformed statistics.  Means and covariances of
both classes are summed over all labelled rows by Spark; covariances are shrunk
towards the pooled one and towards a multiple of the identity, and factored
once.  A score is the logistic of the difference of the two log densities, from
Mahalanobis distances through the Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.code import sent
from leakscan.llm.store import stored
from leakscan.llm.words import mixed, sliced, utf8, words

TOWARDS_POOLED = 0.1
TOWARDS_IDENTITY = 0.02
CUT = 0.7

_LETTER, _UPPER, _DIGIT, _STOP, _SYMBOL, _LINE = range(6)
_KIND = np.zeros((6, 256), bool)
_KIND[_LETTER, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND[_UPPER, 65:91] = True
_KIND[_DIGIT, 48:58] = True
_KIND[_STOP, [ord(c) for c in ".,;:?'\"()-"]] = True
_KIND[_SYMBOL, 33:127] = ~(_KIND[_LETTER] | _KIND[_DIGIT] | _KIND[_STOP])[33:127]
_KIND[_LINE, 10] = True

FEATURES = (
    "size", "letters", "capitals", "digits", "stops", "symbols", "lines", "word_size", "new_words", "new_pairs",
    "repeats", "longest_word",
)


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a flag between the offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[at])


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each row has."""
    with np.errstate(over="ignore"):
        named = mixed(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(named, return_index=True)[1]
    return np.bincount(row[first], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; an empty or null text has zeros."""
    data, at = utf8(column)
    n = len(at) - 1
    size = np.diff(at).astype(float)
    share = np.maximum(size, 1)
    kinds = [_per_text(kind[data], at) / share for kind in _KIND]
    found = words(data, at)
    keys, row, counts = found.hashes(), found.text_of(), found.counts
    some = np.maximum(counts, 1)
    length = (found.end - found.start).astype(float)
    follows = np.flatnonzero(row[1:] == row[:-1]) + 1
    with np.errstate(over="ignore"):
        pair = mixed(keys[follows - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[follows])
    pairs = np.bincount(row[follows], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    out = np.stack(
        [
            np.log1p(size),
            *(np.sqrt(k) for k in kinds),
            np.log1p(np.bincount(row, length, n) / some),
            _distinct(keys, row, n) / some,
            _distinct(pair, row[follows], n) / np.maximum(pairs, 1),
            np.sqrt(np.bincount(row[follows][keys[follows] == keys[follows - 1]], minlength=n) / some),
            np.log1p(longest),
        ],
        axis=1,
    )
    out[size == 0] = 0
    return out


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x array<double>), one per row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = statistics(batch.column("text"))
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    sent(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class the sums of 1, x and products of x, by place in one flat row."""
    size = 1 + len(FEATURES)
    sums = np.zeros((2, size, size))
    for batch in batches:
        x = np.concatenate([np.ones((batch.num_rows, 1)), _matrix(batch.column("x"))], axis=1)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            sums[c] += x[y == c].T @ x[y == c]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], ["place", "total"]
    )


class Model:
    """Mean, inverse Cholesky factor and log density constant of both classes."""

    def __init__(self, sums: np.ndarray, towards_pooled: float, towards_identity: float):
        size = len(FEATURES)
        n = sums[:, 0, 0]
        self.known = bool((n > 0).all())
        # With one class missing there is nothing to tell apart: all texts score its share.
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        if not self.known:
            return
        self.mean = sums[:, 0, 1:] / n[:, None]
        own = sums[:, 1:, 1:] / n[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
        self.factor, self.constant = [], []
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        for c in (0, 1):
            cov = (1 - towards_pooled) * own[c] + towards_pooled * pooled
            cov = (1 - towards_identity) * cov + towards_identity * np.diag(scale**2)
            factor = np.linalg.cholesky(cov + 1e-9 * np.eye(size))
            self.factor.append(np.linalg.inv(factor))
            self.constant.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.share)
        logs = [self.constant[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def train(
    described_docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    towards_pooled: float = TOWARDS_POOLED,
    towards_identity: float = TOWARDS_IDENTITY,
) -> Model:
    """A model from all rows of ``labels`` with label 0 or 1 and a described document; each repeated row counts."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = described_docs.join(y.filter("y in (0, 1)"), "doc_id").select("x", "y")
    parts = rows.mapInArrow(_moments, "place int, total double")
    size = 1 + len(FEATURES)
    sums = np.zeros(2 * size * size)
    for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        sums[r.place] = r.total
    return Model(sums.reshape(2, size, size), towards_pooled, towards_identity)


def scored(described_docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Rows (doc_id, score, predicted): the likelihood of label 1, and whether it reaches ``cut``."""
    known = described_docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = known.value.scores(_matrix(batch.column("x")))
            columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return described_docs.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row of ``docs`` by a model of ``labels``: (doc_id, score, predicted).

    Only the text is judged.  Null and empty texts get the score of a text
    without statistics; rows may share an id or have none.  Labels for absent
    documents and labels other than 0 and 1 are not used; with one class only,
    or none, every score is the share of label 1, or 0.5.  Other columns of
    either table are not read.
    """
    found = stored(described(docs, id_col, text_col), "described")
    return scored(found, train(found, labels, id_col=id_col))

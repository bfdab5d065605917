"""Token counts of the sections of a document, from one encoding of the whole.

Encoding sections one by one would cut tokens at their borders.  Here a text is
encoded once, each token's span of characters is worked out, and the spans are
interval-joined to the sections.  A token that crosses a border goes to one
section by a rule that the caller names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.bpe import Tokenizer
from leakscan.llm.words import hand_back

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of so many bytes; one that holds part of a character has all of it."""
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return character[ends - sizes], character[ends - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines, each with its line feed; an empty text has none."""
    sizes = np.array([len(line) + 1 for line in text.split("\n")], np.int64)
    sizes[-1] -= 1
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def disjoint(listed: list[tuple[int | None, int | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the list, start and end of the sections that hold something, in order and cut where they overlap."""
    found, reached = [], None
    for start, end, place in sorted((a, b, k) for k, (a, b) in enumerate(listed) if a is not None and b is not None):
        start = start if reached is None else max(start, reached)
        if start < end:
            found.append((place, start, end))
            reached = end
    place, start, end = np.array(found, np.int64).reshape(-1, 3).T
    return place, start, end


def attributed(
    begin: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section (-1: none), and whether it crosses a border of a section it meets.

    Sections are in order and do not overlap.  ``first`` and ``last`` go by the
    section of the token's first or last character, ``most`` by the section
    that holds most of its characters, of equal ones the earlier.
    """
    if not len(start):
        return np.full(len(begin), -1), np.zeros(len(begin), bool)

    def holding(at):
        k = np.searchsorted(start, at, "right") - 1
        return np.where((k >= 0) & (at < stop[k]), k, -1)

    # The sections that a token meets are those from a to b.
    a = np.searchsorted(stop, begin, "right")
    b = np.searchsorted(start, end, "left") - 1
    inside = (a == b) & (begin >= start[np.minimum(a, len(start) - 1)]) & (end <= stop[np.minimum(a, len(start) - 1)])
    crossing = (a <= b) & ~inside
    if rule == "first":
        return holding(begin), crossing
    if rule == "last":
        return holding(end - 1), crossing
    section = np.where(a <= b, np.minimum(a, len(start) - 1), -1)
    for t in np.flatnonzero(crossing & (a < b)).tolist():
        k = np.arange(a[t], b[t] + 1)
        section[t] = k[np.argmax(np.minimum(stop[k], end[t]) - np.maximum(start[k], begin[t]))]
    return section, crossing


def token_counts(
    docs: DataFrame,
    tokenizer: Tokenizer,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "first",
) -> DataFrame:
    """Rows (doc_id, section, start, end, n_tokens, n_crossing), in characters.

    Sections are the lines of a text, each with its line feed, or those that
    ``sections_col`` lists as array<struct<start, end>>.  ``section`` is the
    place in the list, from 0, and every listed section has a row, with its ends
    as they are listed.  They may come in any order; of characters that several
    sections have, the one that starts first holds them, of equal ones the one
    listed first.  Sections that are null, lack an end, or end before they start
    hold nothing, and a null list has none.  Tokens outside all sections are
    counted in a row of section -1 with null ends, present only if there are any.
    n_crossing counts the section's tokens that reach over a border.  Null and
    empty texts have a row for each listed section, with no tokens, and no row
    without such a list.  Each row of ``docs`` is attributed by itself, whatever
    its id.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    listed = F.lit(None).cast("array<struct<start:long,end:long>>")
    if sections_col:
        listed = F.col(sections_col).cast("array<struct<start:long,end:long>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        size_of = np.zeros(max(encoder.vocabulary.bytes_of) + 1, np.int64)
        for token, data in encoder.vocabulary.bytes_of.items():
            size_of[token] = len(data)
        for batch in tokenizer.sliced(batches):
            out: list[list[np.ndarray]] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = zip(texts, batch.column("sections").to_pylist(), encoder.encode_all(texts))
            for row, (text, own, found) in enumerate(rows):
                if sections_col:
                    listed = [(s["start"], s["end"]) if s else (None, None) for s in own or ()]
                    place, start, stop = disjoint(listed)
                else:
                    start, stop = lines(text) if text else (np.zeros(0, np.int64),) * 2
                ids = np.array(found, np.int64)
                begin, end = spans(text, size_of[ids]) if len(ids) else (ids, ids)
                section, crossing = attributed(begin, end, start, stop, rule)
                if sections_col:
                    # From the order of the text to the places in the list.
                    section = np.append(place, -1)[section]
                n = len(listed) if sections_col else len(start)
                counts = np.bincount(section + 1, minlength=n + 1)
                crossed = np.bincount(section + 1, weights=crossing, minlength=n + 1).astype(np.int64)
                keep = np.arange(0 if counts[0] else 1, n + 1)
                if sections_col:
                    ends = [pa.array([None, *side], pa.int64()) for side in zip(*listed)] or [pa.nulls(1, pa.int64())] * 2
                    at = [side.take(pa.array(keep)) for side in ends]
                else:
                    at = [pa.array(np.concatenate([[0], x])[keep], mask=keep == 0) for x in (start, stop)]
                out.append([np.full(len(keep), row), keep - 1, *at, counts[keep], crossed[keep]])
            row, section, start, stop, n, crossed = zip(*out)
            columns = [
                batch.column("doc_id").take(pa.array(np.concatenate(row))),
                pa.array(np.concatenate(section).astype(np.int32)),
                pa.concat_arrays(start),
                pa.concat_arrays(stop),
                pa.array(np.concatenate(n).astype(np.int64)),
                pa.array(np.concatenate(crossed)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])
        encoder.forget()
        hand_back()

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), listed.alias("sections")
    )
    return rows.mapInArrow(run, SCHEMA)

"""Array column functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions.text import let

BLOCK = 256


def bind(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column so that later filters and lookups cannot re-evaluate it.

    The optimizer copies a projected expression into every filter on it; it
    does not look through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def rows_literal(rows: list[dict], row_type: str) -> Column:
    """A small table as one array literal (the optimizer folds the parsing away)."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{row_type}>>")


def fold_emit(items: Column, state: Column, step, emitted_type: str) -> Column:
    """Fold over an array, emitting at most one element per item.

    ``step(state, item)`` gives ``struct(state, emit)``, with a null ``emit`` to
    emit nothing.  The result is ``struct(state, out)``: the last state and the
    emitted elements.  Appending copies an array, so the items are taken in
    blocks: with n items, the copies come to about n * BLOCK / 2 elements
    rather than n * n / 2.
    """
    nothing = F.array().cast(f"array<{emitted_type}>")
    no_blocks = F.array().cast(f"array<array<{emitted_type}>>")

    def one(acc: Column, item: Column) -> Column:
        return let(
            step(acc.state, item),
            lambda r: F.struct(
                r.state.alias("state"),
                F.when(r.emit.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(r.emit))).alias("out"),
            ),
        )

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc.state.alias("state"), nothing.alias("out"))
        return let(
            F.aggregate(part, start, one),
            lambda r: F.struct(r.state.alias("state"), F.concat(acc.out, F.array(r.out)).alias("out")),
        )

    # An empty array gives one empty block.
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
    parts = F.transform(starts, lambda i: F.slice(items, i, F.lit(BLOCK)))
    return F.aggregate(
        parts,
        F.struct(state.alias("state"), no_blocks.alias("out")),
        block,
        lambda acc: F.struct(acc.state.alias("state"), F.flatten(acc.out).alias("out")),
    )


def cut_blocks(text: Column, size: int = 16384) -> Column:
    """A text as an array of blocks of ``size`` characters.

    Finding a position in a string takes a walk from its start.  In blocks the
    walk is bounded, however long the text.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def between(blocks: Column, start: Column, end: Column, size: int = 16384) -> Column:
    """The characters from ``start`` up to ``end`` of a text cut in blocks."""
    first, last = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    within = F.substring(F.get(blocks, first), start - first * size + 1, end - start)
    across = F.concat(
        F.substring(F.get(blocks, first), start - first * size + 1, F.lit(size)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end - last * size), F.lit("")),
    )
    return F.when(first == last, within).otherwise(across)

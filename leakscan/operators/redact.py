"""Rewriting texts from their findings, and marked-up review reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions.arrays import between, cut_blocks
from leakscan.functions.text import FULL_REDACTION, escape_html, let, partial_mask


def replacement(finding: Column, mode: Column) -> Column:
    return (
        F.when(mode == "placeholder", finding.placeholder)
        .when(mode == "partial-mask", partial_mask(finding.match))
        .otherwise(F.lit(FULL_REDACTION))
    )


def _rewrite(text: Column, findings: Column, inside, outside=lambda gap: gap) -> Column:
    """Rebuild a text from the gaps between disjoint findings and their stand-ins.

    Builds the pieces and joins them once; splicing the text per finding would
    copy it as often as it has findings.
    """
    def joined(blocks: Column, fs: Column) -> Column:
        def piece(f: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(fs, i - 1).end_pos)
            return F.concat(outside(between(blocks, before, f.start_pos)), inside(f))

        tail = between(blocks, F.element_at(fs, -1).end_pos, F.length(text))
        return F.concat(F.array_join(F.transform(fs, piece), ""), outside(tail))

    return let(
        findings,
        lambda fs: F.when(F.size(fs) == 0, outside(text)).otherwise(
            let(cut_blocks(text), lambda blocks: joined(blocks, fs))
        ),
    )


def redacted(text: Column, findings: Column, mode: Column) -> Column:
    return _rewrite(text, findings, lambda f: replacement(f, mode))


def redact(
    scanned: DataFrame, mode: str | Column, *, text_col: str = "text", output: str = "redacted"
) -> DataFrame:
    """Add the rewritten text.  Only composer text is rewritten, never files."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    rewritable = F.filter("findings", lambda f: f.origin != "attachment")
    return scanned.withColumn(output, redacted(F.col(text_col), rewritable, mode))


def highlighted(text: Column, findings: Column) -> Column:
    """The text as markup with each finding marked by category."""
    return _rewrite(
        text,
        findings,
        lambda f: F.concat(
            F.lit('<mark class="found found--'), f.category, F.lit('">'),
            escape_html(f.match), F.lit("</mark>"),
        ),
        escape_html,
    )


def replacement_preview(text: Column, findings: Column, mode: Column) -> Column:
    """The rewritten text as markup with each stand-in marked."""
    return _rewrite(
        text,
        findings,
        lambda f: F.concat(
            F.lit('<mark class="found found--replacement">'),
            escape_html(replacement(f, mode)), F.lit("</mark>"),
        ),
        escape_html,
    )

"""Texts too long for one row, scanned in chunks that give what the whole would.

A text comes as chunks, each a run of whole lines.  Between two chunks is a
seam.  Where no match of any rule can reach across a seam, the two sides are
independent: the scan of either finds what the scan of the whole finds there,
and overlaps are resolved on each side alone.  Such a seam is quiet.  Chunks
that meet at a seam that is not are put together and scanned as one; so a match
is never cut, however long it is.

How a seam is judged.  Except for key blocks, a match crosses white space at
most ``MOST_RUNS`` times, so what crosses a seam lies within that many words on
either side.  The rules are tried there at every place; the line feed at the
seam is written as a mark that counts as white space, and a match with that
mark inside crosses.  A seam whose words do not fit into ``HALO`` characters is
not quiet.  Key blocks run from a first line to the next last line: a seam is
inside one if the last such line before it opens a block and one after it closes
one.

Only chunk lengths, marks and the characters next to seams are compared across
chunks; texts move only where chunks are put together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions import regex
from leakscan.functions.text import let
from leakscan.operators.detect import scan
from leakscan.operators.policy import Policy
from leakscan.operators.rules import Rule
from leakscan.sources.shared import stored

CHUNK = 1 << 20  # characters, or one line
HALO = 4096
MOST_RUNS = 24  # a phone number of single digits has the most
MARK = "\u2028"
BLOCK_RULE = "pem-private-key"
OPENS = r"-----BEGIN(?: RSA| EC| DSA| OPENSSH)? PRIVATE KEY-----"
CLOSES = r"-----END(?: RSA| EC| DSA| OPENSSH)? PRIVATE KEY-----"
# What may match a line feed, or asks for the start or end of the whole text, in a user's pattern.
_REACHES = re.compile(r"\\[sWDnrvfxucpP0]|\[\^|[\n\r]|\(\?<?[=!]")


def confined(rule: Rule) -> bool:
    """Whether matches of a user's pattern stay within a line, and do not ask where the text begins or ends."""
    anchored = "m" not in rule.flags and re.search(r"(?<!\\)[\^$]", re.sub(r"\[[^\]]*\]", "", rule.pattern))
    return not (_REACHES.search(rule.pattern) or "s" in rule.flags or "y" in rule.flags or anchored)


def cut(df: DataFrame, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """Texts as rows (..., block, chunk, text) of whole lines, each of ``size`` characters or a line more."""
    text = F.col(text_col)
    steps = F.sequence(F.lit(size), F.greatest(F.length(text), F.lit(size)), F.lit(size))
    feeds = F.transform(steps, lambda at: F.call_function("locate", F.lit("\n"), text, at))
    # The line feeds at which the text is cut, between the places before its start and after its end.
    ends = F.concat(F.array_distinct(F.filter(feeds, lambda at: at > 0)), F.array(F.length(text) + 1))

    def piece(end: Column, i: Column, all_ends: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(all_ends, i - 1))
        return F.substring(text, start + 1, end - start - 1)

    # Whether a text is one chunk or many, it is the same rows that come out.
    pieces = let(ends, lambda found: F.transform(found, lambda end, i: piece(end, i, found)))
    others = [c for c in df.columns if c != text_col]
    rows = df.select(*others, F.posexplode(F.coalesce(pieces, F.array(text))).alias("chunk", "text"))
    return rows.withColumn("block", F.lit(0).cast("long"))


def _crosses(tail: Column, head: Column, rules: list[Rule]) -> Column:
    """Whether a match of a rule may reach from the text before a seam into the text after it."""
    window = F.concat(F.replace(tail, F.lit(MARK), F.lit("\n")), F.lit(MARK), F.replace(head, F.lit(MARK), F.lit("\n")))

    def tried(text: Column) -> Column:
        found = F.lit(False)
        for rule in rules:
            if rule.id == BLOCK_RULE or rule.source != "builtin":
                continue
            java = regex.to_java(rule.pattern, rule.flags)
            matches = F.regexp_extract_all(text, F.lit(f"(?=({java}))"), F.lit(1))
            found = found | F.exists(matches, lambda m: F.instr(m, MARK) > 1)
        return found

    return let(window, tried)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _first_words(text: Column) -> Column:
    """The words that a match which begins before the text may reach, and two more."""
    return F.regexp_extract(text, rf"\A\s*+(?:\S++\s*+){{0,{MOST_RUNS + 2}}}", 0)


def stitched(rows: DataFrame, keys: tuple[str, ...], rules: list[Rule]) -> DataFrame:
    """Rows (keys, part, offset, line, text): the chunks of each text, put together where a seam is not quiet.

    ``rows`` has the keys, block, chunk and text; texts are in order of block and
    chunk, with a line feed between two chunks.  ``offset`` and ``line`` count the
    characters and line feeds of the text before the part.  Null texts stay null.
    """
    open_ended = [rule.id for rule in rules if rule.source != "builtin" and not confined(rule)]
    if open_ended:
        raise ValueError(f"patterns that may reach across lines need whole texts: {', '.join(open_ended)}")
    rows = stored(rows.select(*keys, "block", "chunk", "text"), "chunks")
    text = F.coalesce("text", F.lit(""))
    marks = F.when(text.contains("-----"), F.regexp_extract_all(text, F.lit(f"({OPENS})|({CLOSES})"), F.lit(0)))
    head, tail = _first_words(F.left(text, F.lit(HALO))), _first_words(F.reverse(F.right(text, F.lit(HALO))))
    facts = rows.select(
        *keys, "block", "chunk", F.length(text).alias("n"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("feeds"),
        F.get(marks, F.size(marks) - 1).contains("BEGIN").alias("opens"),
        F.coalesce(F.exists(marks, lambda m: m.contains("END")), F.lit(False)).alias("closes"),
        # Of a chunk only these words travel.
        head.alias("head"), F.reverse(tail).alias("tail"),
        (_words(head) <= MOST_RUNS).alias("few_first"), (_words(tail) <= MOST_RUNS).alias("few_last"),
    )
    order = Window.partitionBy(*keys).orderBy("block", "chunk")
    before, after = (order.rowsBetween(*r) for r in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)))
    placed = facts.select(
        *keys, "block", "chunk", "head", "few_first", F.row_number().over(order).alias("at"),
        F.lag("tail").over(order).alias("tail"), F.lag("few_last").over(order).alias("few_last"),
        F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum(F.col("feeds") + 1).over(before), F.lit(0)).alias("line"),
        # Whether the last mark before this chunk opens a block, and one from here on closes it.
        (F.coalesce(F.last("opens", ignorenulls=True).over(before), F.lit(False)) & F.max("closes").over(after)).alias("inside"),
    )
    # The costly test comes last, and only where there is a seam that the others leave open.
    joined = F.col("few_last") | F.col("few_first") | F.col("inside")
    begins = F.when(F.col("at") == 1, F.lit(True)).when(joined, F.lit(False)).otherwise(~_crosses(F.col("tail"), F.col("head"), rules))
    runs = placed.select(*keys, "block", "chunk", "at", "offset", "line", begins.cast("long").alias("begins"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = runs.withColumn("part", F.sum("begins").over(so_far)).drop("begins")
    parts = stored(numbered.withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy(*keys, "part"))), "parts")
    met = rows.join(parts, [*keys, "block", "chunk"])
    alone, several = met.filter("chunks = 1"), met.filter("chunks > 1")
    together = several.groupBy(*keys, "part").agg(
        F.min("offset").alias("offset"), F.min("line").alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda c: c["text"]), "\n").alias("text"),
    )
    columns = [*keys, "part", "offset", "line", "text"]
    return alone.select(*columns).unionByName(together.select(*columns))


def scan_chunks(rows: DataFrame, keys: tuple[str, ...], policy: Policy | None = None, **options) -> DataFrame:
    """Scan texts that come in chunks; rows (keys, part, text, findings), in the places of the whole texts.

    ``findings`` are those of :func:`detect.scan`: of all parts of a text
    together they are the findings of the whole.
    """
    policy = policy or Policy()
    parts = stitched(rows, keys, policy.rules(rows.sparkSession))
    scanned = scan(parts, policy, **options)

    def moved(f: Column) -> Column:
        out = f
        for name, by in (("start_pos", "offset"), ("end_pos", "offset"), ("first_line", "line"), ("last_line", "line")):
            out = out.withField(name, f[name] + F.col(by))
        return out

    return scanned.withColumn("findings", F.transform("findings", moved)).drop("offset", "line")


def scan_long(
    df: DataFrame, keys: tuple[str, ...], policy: Policy | None = None, *, text_col: str = "text", size: int = CHUNK, **options
) -> DataFrame:
    """Scan texts, the long ones in many tasks; see :func:`scan_chunks`.  ``keys`` tell the rows apart."""
    chunks = cut(df.select(*keys, F.col(text_col).alias("text")), "text", size)
    return scan_chunks(chunks, keys, policy, **options)

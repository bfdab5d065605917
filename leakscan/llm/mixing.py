"""Mixing sources to target weights, by weighted sampling without replacement.

Each source has a target in words.  A source is taken whole as often as its
target holds it; what is left of the target is filled with documents in the
order of exponential keys, -ln(u) / weight, whose smallest are a weighted sample
(Efraimidis and Spirakis).  u comes from a hash of the document's id, so reruns
agree.

The documents of a source are never sorted in one task.  Their keys are cut into
classes on a logarithmic scale; sums by class, added up from the smallest, tell
in which class the target is reached, a second look in which fine class, and
only the documents of that one are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm.ranks import numbered
from leakscan.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "2024"
FINE = 1 << 20  # classes of keys for each unit of their logarithm
COARSE_BITS = 12  # fine classes of a coarse one, as a power of two
LAST = 1 << 40  # the class of documents that are never preferred
HASH_DIGITS = 13


def _identity(id_col: str, text_col: str) -> Column:
    """The id as text; a row with a null id is told from others by its text."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), digest))


def _home(source_col: str) -> Column:
    """The source as a key to join on; a null source is a source like others."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, source, home, identity, size), the size in words, for each row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _home(source_col).alias("home"),
        _identity(id_col, text_col).alias("identity"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def keyed(rows: DataFrame, quality: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """``rows`` of :func:`sized` with their exponential ``key``, and ``rank``, its class.

    ``quality`` has (doc_id, weight): of several weights of a document the
    greatest holds; without one, or with null, it is 1.  Documents whose weight
    is zero, negative or not a number come last.
    """
    weight = F.lit(1.0)
    if quality is not None:
        weights = quality.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        rows = rows.join(weights.agg(F.max(F.nanvl(F.col("weight").cast("double"), F.lit(0.0))).alias("weight")), "doc_id", "left")
        weight = F.coalesce("weight", F.lit(1.0))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "identity").cast("binary"), 256), 1, HASH_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HASH_DIGITS)
    never = F.lit(float("inf"))
    found = rows.withColumn("key", F.when(weight > 0, -F.log(u) / weight).otherwise(never))
    rank = F.when(F.col("key") == never, F.lit(LAST)).otherwise(F.floor(F.log("key") * FINE))
    return found.withColumn("rank", rank.cast("long")).drop("weight")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """Rows (home, source, source_size, target), one per source.

    The sources, by code point and null last, have the weights in turn, and share
    ``share`` of all words by them.  No target is above ``most_epochs`` times its
    source's size; what is over is shared out again by weight until none is.
    """
    sums = rows.groupBy("home", "source").agg(F.sum("size").alias("source_size"))
    listed = numbered(stored(sums, "sources"), F.col("source").asc_nulls_last(), name="n")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    most = F.col("source_size") * most_epochs
    found = stored(listed.select("home", "source", "source_size", most.alias("most"), weight.alias("weight")), "targets")
    row = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.sum("weight").alias("weights")).first()
    words = row.words * share
    # Words for each unit of weight.  They only ever rise, so a source that is full stays full.
    level, before = words / row.weights if row.weights else 0.0, None
    while level != before:
        full = F.col("most") < level * F.col("weight")
        left = found.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)).alias("words"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        before, level = level, (words - left.words) / left.weights if left.weights else level
    return found.select("home", "source", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def _reached(sums: DataFrame, class_col: str) -> DataFrame:
    """Of rows (home, wanted, class, size) the class of each home in which the wanted words are reached, and the words before it."""
    so_far = F.sum("size").over(Window.partitionBy("home").orderBy(class_col).rowsBetween(Window.unboundedPreceding, 0))
    added = sums.withColumn("__to", so_far).withColumn("__from", F.col("__to") - F.col("size"))
    return added.filter((F.col("__from") < F.col("wanted")) & (F.col("__to") >= F.col("wanted"))).select(
        "home", class_col, "wanted", F.col("__from").alias("before")
    )


def plan(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: target, ``epochs`` taken whole, and the last of the keys taken once more (``limit``, in class ``limit_rank``).

    Whole documents are taken.  The one at which the target is reached is among
    them if that leaves the words nearer to the target.  Rows with the same id
    and source stand or fall together.
    """
    size = F.col("source_size")
    goal = goal.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
    goal = stored(goal.withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * size)), "goals")
    open_ones = goal.filter("wanted > 0").select("home", "wanted")
    coarse = F.shiftright("rank", COARSE_BITS)

    by_class = rows.groupBy("home", coarse.alias("coarse")).agg(F.sum("size").alias("size")).join(open_ones, "home")
    first = stored(_reached(by_class, "coarse").select("home", "coarse", "wanted", "before"), "coarse-limits")
    inside = rows.withColumn("coarse", coarse).join(first.drop("before", "wanted"), ["home", "coarse"], "left_semi")
    by_rank = inside.groupBy("home", "rank").agg(F.sum("size").alias("size")).join(first.drop("coarse"), "home")
    second = _reached(by_rank.withColumn("wanted", F.col("wanted") - F.col("before")).drop("before"), "rank")
    second = stored(second, "fine-limits")

    last = rows.join(second.select("home", "rank"), ["home", "rank"], "left_semi")
    units = last.groupBy("home", "rank", "key", "identity").agg(F.sum("size").alias("size"))
    units = units.join(second.drop("rank"), "home")
    so_far = F.sum("size").over(Window.partitionBy("home").orderBy("key", "identity").rowsBetween(Window.unboundedPreceding, 0))
    nearer = 2 * (so_far + F.col("before")) - F.col("size") <= 2 * F.col("wanted")
    limits = units.withColumn("__in", nearer).groupBy("home", F.col("rank").alias("limit_rank")).agg(
        F.max(F.when(F.col("__in"), F.struct("key", "identity"))).alias("limit")
    )
    return stored(goal.join(limits, "home", "left").drop("wanted"), "mix")


def copies() -> Column:
    """How often a row of :func:`sized`, met with its source's :func:`plan`, is in the mix."""
    before = (F.col("rank") < F.col("limit_rank")) | (
        (F.col("rank") == F.col("limit_rank")) & (F.struct("key", "identity") <= F.col("limit"))
    )
    return F.col("epochs") + F.coalesce(before, F.lit(False)).cast("long")


def _planned(
    docs: DataFrame, quality: DataFrame | None, id_col: str, text_col: str, source_col: str,
    weights: tuple[int, ...], most_epochs: int, share: float, seed: str,
) -> DataFrame:
    """The rows of :func:`keyed` with the :func:`plan` of their source.  Texts are read once, and never shuffled."""
    rows = stored(keyed(sized(docs, id_col, text_col, source_col), quality, seed), "keyed")
    return rows.join(plan(rows, targets(rows, weights, most_epochs, share)).drop("source"), "home")


def mix(
    docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS,
    share: float = 1.0, seed: str = SEED,
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one per row of ``docs``.

    ``size`` is the number of words of the text, null and empty texts having
    none; ``taken`` the words that the mix has of the row, repeats counted;
    ``target`` what its source is to give, see :func:`targets`.  ``quality``, as
    for :func:`keyed`, says how much a document is preferred when its source is
    not taken whole.  An empty table gives no rows; other columns do not matter.
    """
    rows = _planned(docs, quality, id_col, text_col, source_col, weights, most_epochs, share, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixture(
    docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS,
    share: float = 1.0, seed: str = SEED, copies_col: str = "copies",
) -> DataFrame:
    """The rows of the mix with all their columns and ``copies``, how often the mix has each; see :func:`mix`.

    A column of that name is replaced.
    """
    rows = _planned(docs, quality, id_col, text_col, source_col, weights, most_epochs, share, seed)
    found = rows.select("home", "identity", copies().alias("copies")).filter("copies > 0").distinct()
    kept = [c for c in docs.columns if c != copies_col]
    whole = docs.select(
        _home(source_col).alias("home"), _identity(id_col, text_col).alias("identity"),
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
    )
    return whole.join(found, ["home", "identity"]).select("row.*", F.col("copies").alias(copies_col))

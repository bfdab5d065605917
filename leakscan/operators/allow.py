"""Which findings exact allow rules cover, at a place and at a time.

A place is a host, or a user and a host.  The rules of one place ride along
with its texts as one array, and are looked up within the row: texts are
neither shuffled nor scanned twice.  A place with more than ``MOST_CARRIED``
rules is crowded: the findings of its texts meet the rules in a join.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions.text import let
from leakscan.operators.policy import allow_key, is_live, moment
from leakscan.sources.shared import stored

MOST_CARRIED = 4000
EVER, NEVER = "0001-01-01 00:00:00", "9999-12-31 00:00:00"  # a rule without a start, and one without an end


def place(name: str) -> str:
    """The column that holds one part of a row's place."""
    return f"__{name}"


def intervals(allow: DataFrame, parts: list[str], as_of: datetime | None = None, timed: bool = False) -> DataFrame:
    """When each key is allowed at each place: (place, key, since, until), ``until`` excluded.

    With ``timed`` a rule holds from its creation to its expiry, and the times
    of rules for one key that touch or overlap are one.  Otherwise the rules
    that are live ``as_of`` hold at any time.
    """
    start, end = (F.lit(t).cast("timestamp") for t in (EVER, NEVER))
    keys = [place(name) for name in parts]
    key = allow_key(F.col("rule_id"), F.col("match_fingerprint")).alias("key")
    named = [F.col(name).alias(place(name)) for name in parts]
    if not timed:
        live = allow.filter(is_live(F.col("expires_at"), as_of))
        return live.select(*named, key).distinct().select("*", start.alias("since"), end.alias("until"))
    times = allow.select(
        *named, key, F.coalesce("created_at", start).alias("since"), F.coalesce("expires_at", end).alias("until")
    )
    times = times.filter("since < until").distinct()
    in_order = Window.partitionBy(*keys, "key").orderBy("since", "until")
    reached = F.max("until").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = times.withColumn("begins", F.coalesce(F.col("since") > reached, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "key", "run").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("run")


def by_place(rules: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rules of each place as one array, and the rules of crowded places as rows."""
    keys = [place(name) for name in parts]
    counts = rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = rules.join(counts.filter(F.col("n") <= MOST_CARRIED), keys, "left_semi")
    many = rules.join(counts.filter(F.col("n") > MOST_CARRIED), keys, "left_semi")
    return _carried(few, keys), many


def any_crowded(allow: DataFrame, parts: list[str], as_of: datetime | None = None, timed: bool = False) -> bool:
    """Whether some place has more rules than ride along with its texts.  This looks at rules alone."""
    counts = intervals(allow, parts, as_of, timed).groupBy(*(place(name) for name in parts)).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > MOST_CARRIED).isEmpty()


def _carried(rules: DataFrame, keys: list[str]) -> DataFrame:
    return rules.groupBy(*keys).agg(F.collect_list(F.struct("key", "since", "until")).alias("__allow"))


def without_carried(scored: DataFrame, key_of, at: Column) -> DataFrame:
    """Take out the raw findings that the row's own rules, in ``__allow``, cover at its time."""
    def covered(f: Column) -> Column:
        return let(
            key_of(f),
            lambda key: F.exists(
                "__allow", lambda r: (r["key"] == key) & (r["since"] <= at) & (r["until"] > at)
            ),
        )

    kept = F.when(F.col("__allow").isNull(), F.col("__raw")).otherwise(F.filter("__raw", lambda f: ~covered(f)))
    return scored.withColumn("__raw", kept).drop("__allow")


def without_joined(scored: DataFrame, rules: DataFrame, parts: list[str], key_of, at: Column) -> DataFrame:
    """The same for crowded places: the keys of the findings are joined with the rules.

    The scanned rows are stored, so that the rules of the scan run once; what is
    allowed in a row comes back to it by the row's number.  A key has times that
    do not touch, so a finding meets one of them at most.
    """
    rows = stored(scored.withColumns({"__row": F.monotonically_increasing_id(), "__at": at}), "scored")
    keys = [place(name) for name in parts]
    found = rows.filter(F.size("__raw") > 0).select(
        "__row", "__at", *keys, F.explode(F.array_distinct(F.transform("__raw", key_of))).alias("key")
    )
    met = found.join(rules, [*keys, "key"]).filter("since <= __at and until > __at")
    allowed = stored(met.groupBy("__row").agg(F.collect_set("key").alias("__keys")), "allowed")
    kept = F.when(F.col("__keys").isNull(), F.col("__raw")).otherwise(
        F.filter("__raw", lambda f: ~F.array_contains(F.col("__keys"), key_of(f)))
    )
    return rows.join(allowed, "__row", "left").withColumn("__raw", kept).drop("__row", "__at", "__keys")


def time_of(at: str | Column | None, as_of: datetime | None) -> Column:
    """The time at which a row is scanned: its own, or ``as_of`` where it has none."""
    now = moment(as_of)
    if at is None:
        return now
    return F.coalesce((F.col(at) if isinstance(at, str) else at).cast("timestamp"), now)


def suppressed(
    df: DataFrame, score, allow: DataFrame, key_of, where: dict[str, Column],
    at: str | Column | None = None, as_of: datetime | None = None, few_places: bool = False,
) -> DataFrame:
    """``score(df)`` without the raw findings that an exact allow rule covers.

    ``score`` adds ``__raw``; ``where`` names the columns of ``allow`` that say
    where a rule holds, with their values in ``df``; ``at`` is each row's time.
    ``few_places`` says that there are a handful of places, whose arrays are
    broadcast.
    """
    parts, when = list(where), time_of(at, as_of)
    keys = [place(name) for name in parts]
    rules = intervals(allow, parts, as_of, timed=at is not None)
    if not df.isStreaming:
        # Read several times below: for the count of each place, and for its rules.
        rules = stored(rules, "allow-rules")
    few, many = by_place(rules, parts)
    placed = df.withColumns({place(name): value for name, value in where.items()})
    crowded = None
    if df.isStreaming:
        # A stream has no second look at its texts: every place's rules ride along.  Where they are many, its micro-batches
        # are scanned as tables (``streaming/live.py``).
        few = _carried(rules, keys)
    else:
        # This looks at rules alone, never at texts.  There are few crowded places for the rules there are, and it is
        # known how few: texts are not shuffled to tell them apart, which would leave all of a host to one task.
        crowded = stored(many.select(*keys).distinct(), "crowded")
        crowded = None if crowded.isEmpty() else crowded
        if crowded is not None and few_places:
            crowded = F.broadcast(crowded)
    calm = placed if crowded is None else placed.join(crowded, keys, "left_anti")
    # Texts that have to be shuffled to their rules are scanned before: where nobody asks for the text itself, it stays behind.
    scored = score(calm.join(F.broadcast(few), keys, "left")) if few_places else score(calm).join(few, keys, "left")
    out = without_carried(scored, key_of, when)
    if crowded is not None:
        busy = score(placed.join(crowded, keys, "left_semi"))
        out = out.unionByName(without_joined(busy, many, parts, key_of, when))
    return out.drop(*keys)

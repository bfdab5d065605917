"""Users' own patterns as a table: which ones a text may match.

The patterns of a user ride along with the user's texts as one array, and each
is run only where the text has the literal it starts with.  A user with more
than ``MOST_CARRIED`` patterns is busy: an index of the first characters of the
literals meets each text in its row, and leaves it the few patterns that find
something there which no earlier one finds.  Neither patterns nor texts are
multiplied on disk.  Patterns are rows, whatever their number: the plan does
not grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions import patterns as written
from leakscan.functions import text as tx
from leakscan.operators.rules import CLOSE, CUSTOM_BASE, OPEN
from leakscan.sources.shared import stored

MOST_CARRIED = 200
GRAMS = (written.LEAST_LITERAL, 4, 6, 8)  # the lengths by which a literal is looked up, each by the greatest it has
PIECE = 64  # characters of a long word looked at together
SHARES = 64  # of a busy user's texts, at most
WORK_OF_SHARE = 1_000_000  # rules that meet a text; a text by itself is as much work as so many
WORK_OF_TEXT = 500
OWN = "__own"  # the patterns of a row's user
LINES = "__own_lines"  # and the workspace patterns
FIELDS = ("id", "label", "category", "explanation", "placeholder", "base", "java", "literal", "fold", "starts", "on_a_line")
SHOWN = FIELDS[:5]


def _flags(flags: Column) -> Column:
    return tx.sanitize_flags(F.coalesce(F.nullif(flags, F.lit("")), F.lit("g")))


def refused(patterns: DataFrame) -> DataFrame:
    """The patterns that a scan of many users does not use, with ``reason``; other columns stay.

    ``patterns`` has pattern and flags, like the custom and workspace tables.
    """
    reason = written.refusal(F.coalesce("pattern", F.lit("")), _flags(F.col("flags")))
    return patterns.withColumn("reason", reason).filter("reason is not null")


def accepted(patterns: DataFrame) -> DataFrame:
    """The enabled patterns that can be run, with ``java``, ``literal``, ``starts`` and ``fold``, whether case does not matter to it."""
    flags = _flags(F.col("flags"))
    usable = patterns.filter(F.col("enabled") & written.refusal(F.col("pattern"), flags).isNull())
    return usable.withColumns(
        {
            "java": written.java(F.col("pattern"), flags),
            "literal": written.literal(F.col("pattern"), flags),
            "fold": flags.contains("i"),
            "starts": written.starts(F.col("pattern"), flags),
            "on_a_line": written.on_a_line(F.col("pattern"), flags),
        }
    )


def as_rules(patterns: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Accepted custom patterns as rules: (by, pos, rule).  Without ``pos`` they are taken in the order of their ids."""
    base = F.create_map(*(F.lit(x) for pair in CUSTOM_BASE.items() for x in pair))
    blank = [F.nullif(tx.ws_trim(F.col(c)), F.lit("")) for c in ("explanation", "placeholder")]
    default = F.concat(F.lit('This matches the custom pattern "'), "label", F.lit('".'))
    rules = accepted(patterns).withColumns(
        {
            "explanation": F.coalesce(blank[0], default),
            "placeholder": F.coalesce(blank[1], tx.placeholder_from_label(F.col("label"))),
            "base": base[F.col("category")],
        }
    )
    pos = F.col("pos").cast("long") if "pos" in patterns.columns else F.lit(0).cast("long")
    return rules.select(*by, pos.alias("pos"), F.struct(*FIELDS).alias("rule"))


def _listed(rules: DataFrame, by: list[str]) -> DataFrame:
    """One array of rules for each key, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("rule.id").alias("id"), "rule")))
    return rules.groupBy(*by).agg(F.transform(ordered, lambda x: x["rule"]).alias(OWN))


def gram(literal: Column) -> Column:
    """The first characters of a literal, by which it is looked up."""
    size = F.lit(GRAMS[0])
    for k in GRAMS[1:]:
        size = F.when(F.length(literal) >= k, F.lit(k)).otherwise(size)
    return F.lower(F.left(literal, size))


def grams(text: Column) -> Column:
    """The runs of characters of a text that a literal may start with, in lower case."""
    longest = GRAMS[-1]

    def pieces(word: Column) -> Column:
        # Finding a place in a string takes a walk from its start.
        starts = F.sequence(F.lit(1), F.length(word), F.lit(PIECE - longest))
        cut = F.transform(starts, lambda i: F.substring(word, i, F.lit(PIECE)))
        return F.when(F.length(word) <= PIECE, F.array(word)).otherwise(cut)

    def runs(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(piece) - GRAMS[0] + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(piece, i, F.lit(longest)))

    def cut_to(found: Column, k: int) -> Column:
        return F.transform(found, lambda x: F.left(x, F.lit(k)))

    def of_each_length(found: Column) -> Column:
        return F.flatten(F.array(found, *(cut_to(found, k) for k in GRAMS[:-1])))

    words = F.array_distinct(F.split(F.lower(text), written.NOT_LITERAL))
    found = F.flatten(F.transform(F.flatten(F.transform(words, pieces)), runs))
    return tx.let(F.array_distinct(found), of_each_length)


def once_each(rules: DataFrame, by: list[str], allow: DataFrame) -> DataFrame:
    """Of a user's rules that find and score the same, the first.

    The others' findings lose against its own, except where an allow rule takes
    those out: rules that one names stay.
    """
    named = allow.select(*by, F.col("rule_id").alias("__id")).distinct()
    placed = rules.withColumn("__id", F.col("rule.id"))
    first = F.min(F.struct("pos", F.col("__id").alias("id"), "rule")).alias("first")
    same = placed.join(named, [*by, "__id"], "left_anti").groupBy(*by, F.col("rule.java").alias("java"), F.col("rule.category").alias("category"))
    kept = same.agg(first).select(*by, "first.pos", "first.rule", F.lit(False).alias("named"))
    return kept.unionByName(placed.join(named, [*by, "__id"], "left_semi").drop("__id").withColumn("named", F.lit(True)))


def by_user(
    patterns: DataFrame, by: tuple[str, ...], allow: DataFrame, every: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """The rules of each user as one array, and the rules of busy users as rows, if there are any.

    ``allow`` are the users' exact allow rules.  With ``every`` all users have
    arrays, as a stream needs, which has no second look at its texts.
    """
    rules = stored(as_rules(patterns, by), "patterns")
    if every:
        return _listed(rules, list(by)), None
    counts = rules.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    few = rules.join(counts.filter(F.col("n") <= MOST_CARRIED), list(by), "left_semi")
    busy = rules.join(counts.filter(F.col("n") > MOST_CARRIED), list(by), "left_semi")
    # This looks at patterns alone, never at texts.
    return _listed(few, list(by)), None if busy.isEmpty() else stored(once_each(busy, list(by), allow), "busy-patterns")


def _numbered(busy: DataFrame, by: list[str]) -> DataFrame:
    """Each rule with its number among those of its user, in order, and the grams of its literals as keys."""
    order = Window.partitionBy(*by).orderBy("pos", F.col("rule.id"))
    keys = F.array_distinct(F.transform("rule.starts", gram))
    return busy.select(*by, (F.row_number().over(order) - 1).alias("at"), "rule", "named", keys.alias("keys"))


def _indexed(rules: DataFrame, by: list[str]) -> DataFrame:
    """The rules of each user in one array, where in it those without keys are, and where those of each key, in the order of keys."""
    listed = F.array_sort(F.collect_list("at"))
    all_rules = rules.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "rule", "named"))).alias("__rules"))
    always = rules.filter(F.size("keys") == 0).groupBy(*by).agg(listed.alias("__always"))
    groups = rules.withColumn("key", F.explode("keys")).groupBy(*by, "key").agg(listed.alias("at"))
    groups = groups.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "at"))).alias("__groups"))
    out = all_rules.join(always, by, "left").join(groups, by, "left")
    return out.withColumns({"__keys": F.col("__groups.key"), "__groups": F.col("__groups.at")})


def _place(ordered: Column, value: Column) -> Column:
    """Where a value is in an array in order that has it."""
    def halved(at: Column, _: Column) -> Column:
        middle = F.shiftright(at.low + at.high, 1)
        before = F.get(ordered, middle) < value
        return F.struct(F.when(before, middle + 1).otherwise(at.low).alias("low"), F.when(before, at.high).otherwise(middle).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ordered)))), whole, halved, lambda at: at.low)


def _finding_first(rules: Column, near: Column, text: Column) -> Column:
    """Of rules those that find something, each the first of its category to find just that; their numbers.

    ``near`` has the lines on which a match may be.  A finding loses against an
    equal one of an earlier rule, but not of one that an allow rule names.
    """
    def seen(r: Column) -> Column:
        where = F.when(r.rule.on_a_line, near).otherwise(text)
        return tx.let(where, lambda t: tx.let(
            F.regexp_replace(t, r.rule.java, F.lit(f"{OPEN}$0{OPEN}")),
            # The text marked at the matches says where they are.
            lambda marked: F.when(F.octet_length(marked) > F.octet_length(t), F.sha2(marked, 256)),
        ))

    each = F.transform(
        rules,
        lambda r: F.struct(r.named.alias("named"), seen(r).alias("found"), r.rule.category.alias("category"), r["at"].alias("at")),
    )

    def first_of(x: Column, before: Column) -> Column:
        same = (before.found == x.found) & (before.category == x.category) & (before.named == x.named)
        return x.named | ~F.coalesce(same, F.lit(False))

    def kept(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, n: first_of(x, F.get(ordered, n - 1)))

    return F.transform(tx.let(F.array_sort(F.filter(each, lambda x: x.found.isNotNull())), kept), lambda x: x["at"])


def _safe(text: Column) -> Column:
    """A text as it is searched, without the characters that mark matches."""
    return F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")


def _chosen(text: Column, tried: bool) -> Column:
    """The rules of a row's user that its text may match, in order, or if they are ``tried`` those whose findings may stay."""
    rules, always, groups, known = (F.col(f"__{name}") for name in ("rules", "always", "groups", "keys"))
    none = F.array().cast("array<int>")

    def met(text: Column) -> Column:
        return F.coalesce(F.array_intersect(known, grams(text)), F.array().cast("array<string>"))

    def listed(numbers: Column) -> Column:
        return F.transform(numbers, lambda n: F.get(rules, n))

    def at(key: Column) -> Column:
        return F.get(groups, _place(known, key))

    def matching(safe: Column) -> Column:
        lines = F.transform(F.split(safe, "\n", -1), lambda line: F.struct(line.alias("line"), F.lower(line).alias("low")))

        def by_key(lines: Column, key: Column) -> Column:
            near = F.array_join(F.transform(F.filter(lines, lambda x: x.low.contains(key)), lambda x: x.line), "\n")
            return tx.let(near, lambda near: _finding_first(listed(at(key)), near, safe))

        found = tx.let(lines, lambda lines: F.flatten(F.transform(met(safe), lambda key: by_key(lines, key))))
        return F.concat(found, F.coalesce(_finding_first(listed(always), safe, safe), none))

    if tried:
        numbers = tx.let(_safe(text), matching)
    else:
        numbers = F.concat(F.flatten(F.transform(met(text), at)), F.coalesce(always, none))
    # A rule of several keys comes once for each that the text has.
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.get(rules, n).rule)


def looked_up(df: DataFrame, busy: DataFrame, by: tuple[str, ...], text_col: str = "text", tried: bool = False) -> DataFrame:
    """``df`` with the array of rules of busy users cut to those that a text may match.

    ``df`` has the other users' arrays; ``busy`` are the rules of the busy ones.
    If they are ``tried``, those that find nothing, or only what an earlier one
    finds, are left out.  A user's rules meet the texts once, in the row, and
    only what is left of them goes on with it.
    """
    # There are few busy users for the rules there are.
    sizes = F.broadcast(busy.groupBy(*by).agg(F.count(F.lit(1)).alias("__rules")))
    calm = df.join(sizes, list(by), "left_anti")
    # A busy user's texts are dealt out by the work they make, each share with a copy of the rules.
    work = F.count(F.lit(1)) * (F.col("__rules") + WORK_OF_TEXT) / WORK_OF_SHARE
    shares = F.least(F.lit(SHARES), F.ceil(work)).cast("int").alias("__shares")
    dealt = stored(df.join(sizes, list(by)).groupBy(*by, "__rules").agg(shares).drop("__rules"), "busy-users")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = _numbered(busy, list(by)).join(F.broadcast(dealt.select(*by)), list(by), "left_semi")
    copies = _indexed(rules, list(by)).join(F.broadcast(dealt), list(by))
    copies = copies.withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    plain = [c for c, kind in df.dtypes if c != OWN and not kind.startswith(("array", "map", "struct", "variant", "void"))]
    share = F.pmod(F.xxhash64(*plain), F.col("__shares")).cast("int")
    # A semi join goes below the joins that made ``df``: other users' texts are not shuffled for them.
    rows = df.drop(OWN).join(F.broadcast(dealt.select(*by)), list(by), "left_semi").join(F.broadcast(dealt), list(by))
    rows = rows.withColumn("__share", share).drop("__shares")
    # A task's work has nothing to do with its bytes, by which small partitions would be put together.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(parts, *by, "__share").join(copies, [*by, "__share"])
    found = met.withColumn(OWN, _chosen(text, tried)).drop("__share", "__rules", "__always", "__groups", "__keys")
    return calm.unionByName(found.select(*calm.columns))


def shown() -> Column:
    """The patterns of a row with what is said of their findings, without what finds them."""
    return F.transform(OWN, lambda p: F.struct(*(p[name].alias(name) for name in SHOWN)))


def lines_by_user(workspace: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The workspace patterns of each user, in Java's form, as one array."""
    return accepted(workspace).groupBy(*by).agg(F.collect_list("java").alias(LINES))

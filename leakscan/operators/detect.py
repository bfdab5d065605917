"""The scan: from a text column to an array of resolved findings.

The whole scan is a narrow projection.  A row's matches stay in one array from
the regex to overlap resolution, so nothing shuffles and no text is copied per
rule.  While they are in flight, findings carry the number of their line rather
than the line itself: a page on a single line with thousands of matches must
not hold thousands of copies of itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions.arrays import bind as _bind, fold_emit, rows_literal
from leakscan.functions.text import allow_fingerprint, is_blank, let, ws_collapse, ws_trim
from leakscan.operators import patterns as own_patterns
from leakscan.operators.allow import suppressed
from leakscan.operators.patterns import LINES, OWN
from leakscan.operators.policy import SITES, THRESHOLDS, Policy, allow_key
from leakscan.operators.rules import CLOSE, OPEN, Rule, screens

# Fixed values.
SEVERITY_WEIGHT = {"critical": 2000, "high": 1000, "medium": 100}
CREDENTIAL_WORDS = "(?i)(?:key|token|secret|authorization|password|bearer)"
WHY_LONG = "The match length is long enough to look like a real credential rather than a short placeholder."
WHY_CONFIDENT = "Confidence is high enough that the scanner treats this as likely production-sensitive."

_LINE = "struct<first:int,last:int,bonus:int,keyword:string,allowed:boolean>"
_FINDING = (
    "struct<start:int,ending:int,ord:int,match:string,first_line:int,last_line:int,"
    "confidence:int,keyword:string,secret:boolean>"
)
_ORDERED = f"struct<start:int,minus_score:int,ord:int,finding:{_FINDING}>"


_built: dict[tuple, Column] = {}
MOST_BUILT = 256


def _once(df: DataFrame, build, *key) -> Column:
    """A large expression, built once an application for each key; it names columns, and so fits any plan."""
    name = (df.sparkSession.sparkContext.applicationId, *key)
    if name not in _built:
        if len(_built) >= MOST_BUILT:
            _built.clear()
        _built[name] = build()
    return _built[name]


def scan(
    df: DataFrame,
    policy: Policy | None = None,
    *,
    text_col: str = "text",
    host_col: str | None = None,
    origin: str | Column = "composer",
    strictness: str | Column | None = None,
    ignore_allow: bool = False,
    as_of: datetime | None = None,
    at: str | Column | None = None,
) -> DataFrame:
    """Add ``findings``, the resolved findings of each row, in text order.

    ``origin`` says where the texts come from, for all rows or as a column;
    ``strictness`` takes the place of that of the host, in the same two ways.
    Exact allow rules are those live ``as_of`` one time; with ``at``, each row's
    own time, those created by then and not yet expired.
    """
    policy = policy or Policy()
    scanned = with_raw_findings(
        df, policy, text_col=text_col, host_col=host_col,
        ignore_allow=ignore_allow, as_of=as_of, at=at,
        # Default profiles all have the default strictness.
        by_host=strictness is None and policy.profiles is not None,
    )
    if isinstance(strictness, Column):
        thresholds = F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))
        threshold = F.coalesce(thresholds[strictness], F.lit(THRESHOLDS["balanced"]))
    elif strictness:
        threshold = F.lit(THRESHOLDS[strictness])
    else:
        threshold = F.coalesce(F.col("__threshold"), F.lit(THRESHOLDS["balanced"]))
    rules = policy.rules(df.sparkSession)

    def found() -> Column:
        return describe(resolve_overlaps(F.filter("__raw", lambda f: f.confidence >= threshold)), rules, origin)

    if isinstance(origin, str) and not isinstance(strictness, Column):
        findings = _once(df, found, "findings", tuple(rules), strictness, origin)
    else:
        findings = found()
    return _bind(scanned, findings, "findings").drop("__raw", "__threshold")


def scan_by_user(
    df: DataFrame, tables, by: tuple[str, ...], *, text_col: str = "text", host_col: str = "hostname",
    origin: str | Column = "composer", as_of: datetime | None = None, at: str | Column | None = None,
) -> DataFrame:
    """Scan every row under the settings of its user; rows that are switched off are left out.

    ``tables`` are the normalised settings of all users, as
    ``sources.settings.settings_tables(raw, by)`` gives them, and ``by`` names
    the columns that identify a user in them and in ``df``.  Toggles, site
    profiles, thresholds, exact allow rules, and the user's own patterns and
    workspace patterns apply; a user without settings is unknown, and off, like
    a site without a profile.  Own patterns are found whatever the toggles.
    ``operators/patterns.py`` says which patterns of a table are run.
    """
    thresholds = F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))
    profiles = tables.profiles.filter("enabled").select(
        *by, F.col("hostname").alias(host_col), thresholds[F.col("strictness")].alias("__least")
    )
    toggles = tables.toggles.filter("enabled").select(
        *by, F.col("detect_secrets").alias("__secrets"), F.col("detect_pii").alias("__pii")
    )
    own, busy = own_patterns.by_user(tables.custom_patterns, by, tables.exact_allow, every=df.isStreaming)
    lines = own_patterns.lines_by_user(tables.workspace_allow, by)
    # All that is known of a user meets before it meets the texts, which are joined once.
    users = toggles.join(own, list(by), "left").join(lines, list(by), "left")
    on = df.join(users.join(profiles, list(by)), [*by, host_col])
    if busy is not None:
        on = own_patterns.looked_up(on, busy, by, text_col, tried=True)
    policy = Policy()
    rules = policy.rules(df.sparkSession)
    where = {name: F.col(name) for name in by} | {"hostname": F.col(host_col)}

    def score(texts: DataFrame) -> DataFrame:
        scored = _scored(texts, policy, rules, text_col, None, False, False, own=True)
        return scored.withColumn(OWN, own_patterns.shown()).drop(LINES)

    raw = suppressed(on, score, tables.exact_allow, _allow_key(rules, own=True), where, at, as_of)
    wanted = F.filter(
        "__raw",
        lambda f: (f.confidence >= F.col("__least"))
        & ((f.ord >= len(rules)) | F.when(f.secret, F.col("__secrets")).otherwise(F.col("__pii"))),
    )
    found = _bind(raw, describe(resolve_overlaps(wanted), rules, origin, own=True), "findings")
    return found.drop("__raw", "__threshold", "__least", "__secrets", "__pii", OWN)


def raw_findings(
    df: DataFrame, policy: Policy | None = None, *, text_col: str = "text",
    origin: str = "composer", rules: list[Rule] | None = None,
) -> DataFrame:
    """Add ``findings``: every scored match, before threshold and overlaps."""
    policy = policy or Policy()
    rules = policy.rules(df.sparkSession) if rules is None else rules
    scanned = with_raw_findings(df, policy, text_col=text_col, rules=rules)
    return _bind(scanned, describe(F.col("__raw"), rules, origin), "findings").drop("__raw", "__threshold")


def with_raw_findings(
    df: DataFrame, policy: Policy, *, text_col: str = "text", host_col: str | None = None,
    ignore_allow: bool = False, as_of: datetime | None = None, rules: list[Rule] | None = None,
    by_host: bool = False, at: str | Column | None = None,
) -> DataFrame:
    """Add ``__raw``, the scored matches no allow rule covers, and the host's ``__threshold``."""
    spark = df.sparkSession
    rules = policy.rules(spark) if rules is None else rules

    def score(texts: DataFrame) -> DataFrame:
        return _scored(texts, policy, rules, text_col, host_col, ignore_allow, by_host)

    if not host_col or policy.exact_allow is None or ignore_allow:
        return score(df)
    # Allow rules of sites that no policy knows hold nowhere.
    allow = policy.exact_allow.filter(F.col("hostname").isin(list(SITES)))
    return suppressed(df, score, allow, _allow_key(rules), {"hostname": F.col(host_col)}, at, as_of, few_places=True)


def _allow_key(rules: list[Rule], own: bool = False):
    """What a finding and an exact allow rule have to agree on, as a function of the finding."""
    ids = rows_literal([{"id": rule.id} for rule in rules], "id:string")

    def id_of(n: Column) -> Column:
        built = F.get(ids, n).id
        return F.coalesce(built, F.get(F.col(OWN), n - len(rules)).id) if own else built

    return lambda f: let(id_of(f.ord), lambda rule_id: allow_key(rule_id, allow_fingerprint(rule_id, f.match)))


def _scored(
    df: DataFrame, policy: Policy, rules: list[Rule], text_col: str, host_col: str | None, ignore_allow: bool, by_host: bool,
    own: bool = False,
) -> DataFrame:
    """Add ``__raw`` and ``__threshold``; with ``own``, the patterns that each row carries count as further rules."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    if host_col and by_host:
        # One row per supported host: a handful, whatever the corpus size.
        hosts = policy.host_table(spark).select(
            F.col("hostname").alias("__host"), F.col("threshold").alias("__threshold")
        )
        df = df.join(F.broadcast(hosts), F.col(host_col) == F.col("__host"), "left").drop("__host")
    else:
        df = df.withColumn("__threshold", F.lit(None).cast("int"))

    # Screens and the lowered text are read by many gates, so they are columns.
    tests = screens(text, rules)
    names = {screen: f"__screen{n}" for n, screen in enumerate(tests)}
    df = df.withColumns({names[screen]: test for screen, test in tests.items()})
    needed = _lowered_needed(rules, names)
    if own:
        needed = needed | F.coalesce(F.exists(OWN, lambda p: p.fold), F.lit(False))
    df = df.withColumn("__low", F.when(needed, F.lower(text)))
    cut = _once(df, lambda: _cut(text, F.col("__low"), rules, names, own), "cut", text_col, tuple(rules), own)
    df = df.withColumn("__cut", cut)
    df = df.withColumn("__lines", F.when(F.size("__cut") > 0, F.split(text, "\n", -1)))
    allowed_lines = [] if ignore_allow else policy.workspace_columns(spark)
    scores = _once(
        df, lambda: _score(F.col("__cut"), F.col("__lines"), rules, allowed_lines, own),
        "scores", tuple(rules), tuple(allowed_lines), own,
    )
    raw = F.when(F.col("__lines").isNull(), F.array().cast(f"array<{_FINDING}>")).otherwise(scores)
    return _bind(df, raw, "__raw").drop("__low", "__cut", "__lines", *names.values())


# --- matches -----------------------------------------------------------------


def _cut(text: Column, lowered: Column, rules: list[Rule], names: dict[str, str], own: bool = False) -> Column:
    """For each rule with a match, the text cut at its matches."""
    safe = F.when(
        text.contains(OPEN) | text.contains(CLOSE),
        F.translate(text, OPEN + CLOSE, "\ufffd\ufffd"),
    ).otherwise(text)
    def screened(rule: Rule) -> Column:
        return F.col(names[rule.gate.screen]) if rule.gate.screen else F.lit(True)

    # An array function keeps these many branches out of the generated row loop,
    # which would grow too large for the JIT to compile.
    pieces = F.array(*(rule.pieces(text, lowered, safe, screened(rule)) for rule in rules))
    numbered = F.transform(pieces, lambda p, n: F.struct(n.alias("ord"), p.alias("pieces")))
    if own:
        def chance(p: Column) -> Column:
            seen = F.when(p.fold, lowered.contains(p.literal)).otherwise(text.contains(p.literal))
            return F.when(p.literal == "", ~is_blank(text)).otherwise(seen)

        def cut_by(p: Column) -> Column:
            return F.split(F.regexp_replace(safe, p.java, F.lit(f"{OPEN}$0{OPEN}")), OPEN, -1)

        more = F.transform(
            OWN, lambda p, n: F.struct((n + len(rules)).alias("ord"), F.when(chance(p), cut_by(p)).alias("pieces"))
        )
        numbered = F.concat(numbered, F.coalesce(more, F.array().cast("array<struct<ord:int,pieces:array<string>>>")))
    return F.filter(numbered, lambda cut: F.size(cut.pieces) > 1)


def _lowered_needed(rules: list[Rule], names: dict[str, str]) -> Column:
    """Whether a gate that ignores case is still open."""
    gates = [rule.gate for rule in rules if rule.gate.low]
    if any(gate.screen is None for gate in gates):
        return F.lit(True)
    needed = F.lit(False)
    for name in dict.fromkeys(names[gate.screen] for gate in gates):
        needed = needed | F.col(name)
    return needed


def looks_like_phone(match: Column) -> Column:
    """Ten to fifteen digits, and not an IPv4 address."""
    digits = F.length(F.regexp_replace(match, r"\D", ""))
    return let(digits, lambda n: (n >= 10) & (n <= 15)) & ~looks_like_ipv4(match)


def looks_like_ipv4(match: Column) -> Column:
    quad = F.regexp_extract(ws_trim(match), r"(?<!\w)(\d{1,3}(?:\.\d{1,3}){3})(?!\w)", 1)
    return let(
        quad, lambda q: (q != "") & F.forall(F.split(q, r"\."), lambda part: part.cast("int") <= 255)
    )


# --- scoring -----------------------------------------------------------------


def lines_at(lines: Column, first: Column, last: Column) -> Column:
    """The full line or lines around a match, trimmed."""
    return ws_trim(F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))


def _score(cut: Column, lines: Column, rules: list[Rule], allowed_lines: list[str], own: bool = False) -> Column:
    """All matches as scored findings, without those on an allowed line.

    One pass per rule over its gaps and matches keeps the offset and the line
    number.  What a rule makes of a line is worked out when a match is on a
    different line than the one before: on a page that is one long line that is
    once, not once per match.
    """
    facts_type = "base:int,secret:boolean,capture_bonus:int,keywords:array<string>,phone:boolean"
    facts = rows_literal(
        [
            {
                "base": rule.base,
                "secret": rule.category == "secret",
                "capture_bonus": 4 if rule.captures else 0,
                "keywords": rule.keywords,
                "phone": rule.id == "phone",
            }
            for rule in rules
        ],
        facts_type,
    )

    def facts_of(n: Column) -> Column:
        if not own:
            return F.get(facts, n)
        p = F.get(F.col(OWN), n - len(rules))
        none = F.array().cast("array<string>")
        user = F.struct(p.base, p.category == "secret", F.lit(0), none, F.lit(False)).cast(f"struct<{facts_type}>")
        return F.when(n < len(rules), F.get(facts, n)).otherwise(user)

    def allowed(value: Column) -> Column:
        test = _matches_any(value, allowed_lines)
        return test | F.coalesce(F.exists(LINES, lambda p: F.rlike(value, p)), F.lit(False)) if own else test
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("line"),
        F.lit(False).alias("inside"),
        F.lit(None).cast(_LINE).alias("seen"),
    )

    def of_rule(pieces: Column, n: Column) -> Column:
        return let(
            facts_of(n),
            lambda rule: fold_emit(pieces, start, lambda st, piece: step(st, piece, rule, n), _FINDING).out,
        )

    def step(st: Column, piece: Column, rule: Column, n: Column) -> Column:
        breaks = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        # A match that opens the text with a line feed counts from the next line.
        first = F.when((st.at == 0) & piece.startswith("\n"), F.lit(1)).otherwise(st.line)
        hit = st.inside & (F.length(piece) > 0) & (~rule.phone | looks_like_phone(piece))

        def moved(to: Column) -> Column:
            seen = (
                F.when(~to.hit, st.seen)
                .when((to.first == st.seen.first) & (to.line == st.seen.last), st.seen)
                .otherwise(_line_facts(lines, to.first, to.line, rule, allowed))
            )
            return let(seen, lambda at_line: result(to, at_line))

        def result(to: Column, at_line: Column) -> Column:
            return F.struct(
                F.struct(
                    to.at.alias("at"), to.line.alias("line"), (~st.inside).alias("inside"), at_line.alias("seen")
                ).alias("state"),
                F.when(to.hit & ~at_line.allowed & ~allowed(piece), finding(to, at_line)).alias(
                    "emit"
                ),
            )

        def finding(to: Column, at_line: Column) -> Column:
            return F.struct(
                st.at.alias("start"),
                to.at.alias("ending"),
                n.alias("ord"),
                piece.alias("match"),
                to.first.alias("first_line"),
                to.line.alias("last_line"),
                confidence(rule, piece, at_line).alias("confidence"),
                at_line.keyword.alias("keyword"),
                rule.secret.alias("secret"),
            )

        to = F.struct(
            (st.at + F.length(piece)).alias("at"), (st.line + breaks).alias("line"),
            first.alias("first"), hit.alias("hit"),
        )
        return let(to, moved)

    return F.flatten(F.transform(cut, lambda c: of_rule(c.pieces, c.ord)))


def _line_facts(lines: Column, first: Column, last: Column, rule: Column, allowed) -> Column:
    """What a rule needs to know about the line of a match."""
    def facts(line: Column, hits: Column) -> Column:
        assigned = (line.contains("=") | line.contains(":")) & line.rlike(CREDENTIAL_WORDS)
        return F.struct(
            first.alias("first"),
            last.alias("last"),
            (F.size(hits) * 6 + F.when(assigned, F.lit(8)).otherwise(F.lit(0))).alias("bonus"),
            F.get(hits, F.lit(0)).alias("keyword"),
            allowed(line).alias("allowed"),
        )

    return let(
        lines_at(lines, first, last),
        lambda line: let(_keywords_in(rule.keywords, line), lambda hits: facts(line, hits)),
    )


def _keywords_in(keywords: Column, line: Column) -> Column:
    """The rule's keywords the line contains, in rule order."""
    return let(F.lower(line), lambda low: F.filter(keywords, lambda k: low.contains(k)))


def _matches_any(value: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | value.rlike(pattern)
    return test


def confidence(rule: Column, match: Column, at_line: Column) -> Column:
    long_secret = F.when(rule.secret & (F.length(match) >= 24), F.lit(4)).otherwise(F.lit(0))
    total = rule.base + at_line.bonus + long_secret + rule.capture_bonus
    return F.greatest(F.lit(1), F.least(F.lit(99), total))


def severity(secret: Column, confidence: Column) -> Column:
    return (
        F.when(secret & (confidence >= 90), F.lit("critical"))
        .when(secret | (confidence >= 82), F.lit("high"))
        .otherwise(F.lit("medium"))
    )


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence >= 80, F.lit("high")).when(confidence >= 60, F.lit("medium")).otherwise(F.lit("low"))
    )


# --- overlaps ----------------------------------------------------------------


def finding_score(f: Column) -> Column:
    weight = (
        F.when(f.secret & (f.confidence >= 90), F.lit(SEVERITY_WEIGHT["critical"]))
        .when(f.secret | (f.confidence >= 82), F.lit(SEVERITY_WEIGHT["high"]))
        .otherwise(F.lit(SEVERITY_WEIGHT["medium"]))
    )
    return weight + f.confidence + (f.ending - f.start)


def resolve_overlaps(raw: Column) -> Column:
    """Keep disjoint findings, left to right.

    Order: start, then the higher score, then the earlier rule.  A finding that
    overlaps the last one kept replaces it only with a strictly higher score;
    what was dropped before is not looked at again.
    """
    ordered = F.array_sort(
        F.transform(
            raw,
            lambda f: F.struct(
                f.start.alias("start"), (-finding_score(f)).alias("minus_score"), f.ord.alias("ord"),
                f.alias("finding"),
            ),
        )
    )

    def step(last: Column, f: Column) -> Column:
        # The last finding is held back until one that does not touch it comes.
        apart = F.coalesce(f.start >= last.finding.ending, F.lit(True))
        replaces = apart | (f.minus_score < last.minus_score)
        return F.struct(
            F.when(replaces, f).otherwise(last).alias("state"), F.when(apart, last.finding).alias("emit")
        )

    return F.when(F.size(raw) < 2, raw).otherwise(
        let(
            fold_emit(ordered, F.lit(None).cast(_ORDERED), step, _FINDING),
            lambda r: F.concat(r.out, F.array(r.state.finding)),
        )
    )


# --- presentation ------------------------------------------------------------


def describe(raw: Column, rules: list[Rule], origin: str | Column, own: bool = False) -> Column:
    """Spell out the fields of each finding."""
    origin = F.lit(origin) if isinstance(origin, str) else origin
    fields = ("id", "label", "category", "source", "placeholder", "explanation")
    facts = rows_literal(
        [{name: getattr(rule, name) for name in fields} for rule in rules],
        ",".join(f"{name}:string" for name in fields),
    )

    def facts_of(n: Column) -> Column:
        if not own:
            return F.get(facts, n)
        p = F.get(F.col(OWN), n - len(rules))
        user = F.struct(p.id, p.label, p.category, F.lit("custom"), p.placeholder, p.explanation)
        return F.when(n < len(rules), F.get(facts, n)).otherwise(
            user.cast(f"struct<{','.join(f'{name}:string' for name in fields)}>")
        )

    def spelled_out(f: Column) -> Column:
        return let(
            facts_of(f.ord),
            lambda rule: F.struct(
                f.ord.alias("rule_ord"),
                rule.id.alias("rule_id"),
                rule.label.alias("label"),
                rule.category.alias("category"),
                severity(f.secret, f.confidence).alias("severity"),
                rule.source.alias("source"),
                f.start.alias("start_pos"),
                f.ending.alias("end_pos"),
                f.match.alias("match"),
                ws_collapse(f.match).alias("snippet"),
                rule.placeholder.alias("placeholder"),
                rule.explanation.alias("explanation"),
                f.confidence.alias("confidence"),
                confidence_label(f.confidence).alias("confidence_label"),
                why(rule.explanation, f.keyword, f.match, f.confidence).alias("why"),
                allow_fingerprint(rule.id, f.match).alias("allow_fingerprint"),
                origin.alias("origin"),
                f.first_line.alias("first_line"),
                f.last_line.alias("last_line"),
            ),
        )

    return F.transform(raw, spelled_out)


def why(explanation: Column, keyword: Column, match: Column, confidence: Column) -> Column:
    reasons = F.array(
        explanation,
        F.when(
            keyword.isNotNull(),
            F.concat(
                F.lit('Nearby context references "'), keyword,
                F.lit('", which increases confidence that this is live data.'),
            ),
        ),
        F.when(F.length(match) >= 24, F.lit(WHY_LONG)),
        F.when(confidence >= 90, F.lit(WHY_CONFIDENT)),
    )
    return F.slice(F.array_compact(reasons), 1, 3)


def explode_findings(scanned: DataFrame, *keys: str, text_col: str = "text", context: bool = True) -> DataFrame:
    """One row per finding, with a stable id and, unless ``context`` is off, the line it was found on."""
    findings = F.col("findings")
    if context:
        # Each finding takes its line along, not the lines of the whole text.
        lines = F.when(F.size(findings) > 0, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
        findings = let(
            lines,
            lambda all_lines: F.transform(
                findings, lambda f: f.withField("context", lines_at(all_lines, f.first_line, f.last_line))
            ),
        )
    parts = [F.col(k).cast("string") for k in keys] + [
        F.col("rule_id"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string")
    ]
    rows = scanned.select(*keys, F.inline(findings))
    return rows.withColumn("finding_id", F.sha2(F.concat_ws(":", *parts), 256))


def summarize(findings: Column) -> Column:
    """Counts, distinct labels and the dominant category of one row's findings."""
    def count(test) -> Column:
        return F.size(F.filter(findings, test))

    secrets = count(lambda f: f.category == "secret")
    pii = count(lambda f: f.category == "pii")
    return F.struct(
        F.size(findings).alias("total"),
        secrets.alias("secrets"),
        pii.alias("pii"),
        count(lambda f: f.severity == "critical").alias("critical"),
        count(lambda f: f.confidence_label == "high").alias("high_confidence"),
        F.array_distinct(F.transform(findings, lambda f: f.label)).alias("rule_labels"),
        F.when(F.size(findings) == 0, F.lit(None))
        .when(secrets >= pii, F.lit("secret"))
        .otherwise(F.lit("pii"))
        .alias("top_category"),
    )

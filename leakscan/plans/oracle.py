"""The detection semantics in DuckDB SQL, as an independent check.

Rows per match rather than arrays, and the patterns as they are given, run by
RE2, where the scan runs its own rewritten forms.
"""

from __future__ import annotations

from leakscan.functions.regex import split_capture
from leakscan.operators.rules import BUILTIN_RULES


def re2(pattern: str, flags: str, captures: bool = False) -> str:
    """A pattern for RE2: flags in front, and three groups where only part of the match is reported."""
    kept = "".join(f for f in "ims" if f in flags)
    if captures:
        pattern = "({})({})({})".format(*split_capture(pattern))
    return (f"(?{kept})" if kept else "") + pattern


RE2 = {rule.id: re2(rule.pattern, rule.flags, rule.captures) for rule in BUILTIN_RULES}
# RE2 has no look-behind and no look-ahead.
RE2["phone"] = r"(?:\B\+\d{1,3}[\s().-]*|\b(?:\d{1,3}[\s().-]*)?)(?:\d[\s().-]*){9,14}\d\b"
CAPTURES = {rule.id for rule in BUILTIN_RULES if rule.captures}

STRICTNESS_SQL = "CASE {c} WHEN 'relaxed' THEN 75 WHEN 'strict' THEN 38 ELSE 58 END"


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


class Rules:
    """The rules a query runs: built-in ones by id, then custom ones."""

    def __init__(self, ids: list[str] | None = None, custom: list[dict] | None = None):
        self.rows = []
        for rule in BUILTIN_RULES:
            if ids is None or rule.id in ids:
                self.rows.append(
                    (rule.id, rule.label, rule.category, "builtin", rule.base, rule.id in CAPTURES,
                     rule.placeholder, rule.explanation, list(rule.keywords), RE2[rule.id])
                )
        for c in custom or []:
            self.rows.append(
                (c["id"], c["label"], c["category"], "custom", {"secret": 82, "pii": 72}[c["category"]], False,
                 c["placeholder"], c["explanation"], [], c["re2"])
            )

    def table(self) -> str:
        values = ",\n".join(
            f"({n}, {q(i)}, {q(label)}, {q(cat)}, {q(src)}, {base}, {str(cap).lower()}, {q(ph)}, {q(ex)}, "
            f"CAST([{', '.join(q(k) for k in kws)}] AS VARCHAR[]))"
            for n, (i, label, cat, src, base, cap, ph, ex, kws, _) in enumerate(self.rows)
        )
        return (
            "rules(ord, rule_id, label, category, source, base, captures, placeholder, explanation, keywords) "
            f"AS (VALUES {values})"
        )

    def cuts(self, keys: str) -> str:
        marks = "'[' || chr(57344) || chr(57345) || ']'"
        branches = []
        for n, row in enumerate(self.rows):
            pattern = q(row[-1])
            if row[0] in CAPTURES:
                to = r"'\1' || chr(57344) || '\2' || chr(57345) || '\3'"
            else:
                to = r"chr(57344) || '\0' || chr(57345)"
            branches.append(
                f"SELECT {keys}, {n} AS ord, "
                f"string_split_regex(regexp_replace(text, {pattern}, {to}, 'g'), {marks}) AS p "
                f"FROM src WHERE regexp_matches(text, {pattern})"
            )
        return "\nUNION ALL\n".join(branches)


class TableRules(Rules):
    """The built-in rules and, for each text, those of its user from a table.

    ``own`` yields ord, user_key, id, label, category and re2, with ``ord`` from ``len(rows)`` on.
    """

    def __init__(self, own: str):
        super().__init__()
        self.own = own

    def table(self) -> str:
        base = super().table().replace("AS (VALUES", "AS (SELECT * FROM (VALUES", 1)
        return f"""own AS MATERIALIZED ({self.own}),
{base[:-1]}) UNION ALL SELECT ord, id, label, category, 'custom', CASE category WHEN 'secret' THEN 82 ELSE 72 END, false,
  '', '', CAST([] AS VARCHAR[]) FROM own)"""

    def cuts(self, keys: str) -> str:
        columns = ", ".join(f"src.{k}" for k in keys.split(", "))
        return super().cuts(keys) + rf"""
UNION ALL
SELECT {columns}, own.ord, string_split_regex(regexp_replace(text, re2, chr(57344) || '\0' || chr(57345), 'g'),
  '[' || chr(57344) || chr(57345) || ']') AS p
FROM src JOIN own ON own.user_key = src.user_key WHERE regexp_matches(text, re2)"""


def scored(src: str, keys: str, rules: Rules | None = None) -> str:
    """CTEs up to ``scored``: one row per match, before any filter.

    ``src`` yields ``keys`` and ``text`` (and whatever else the caller needs).
    """
    rules = rules or Rules()
    on = ", ".join(keys.split(", "))
    return rf"""
src AS MATERIALIZED ({src}),
{rules.table()},
cut AS ({rules.cuts(keys)}),
piece AS (SELECT {keys}, ord, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM cut),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY {keys}, ord ORDER BY i) - length(piece) AS s FROM piece),
hit AS (
  SELECT {keys}, ord, CAST(s AS BIGINT) AS s, CAST(s + length(piece) AS BIGINT) AS e, piece AS m
  FROM placed WHERE i % 2 = 0 AND length(piece) > 0),
valid AS (
  SELECT hit.* FROM hit JOIN rules USING (ord)
  WHERE rule_id <> 'phone' OR ({PHONE_OK})),
lined AS (
  SELECT valid.*, regexp_replace(
      string_split(left(text, s), chr(10))[-1] || m || string_split(substr(text, e + 1), chr(10))[1],
      '^\s+|\s+$', '', 'g') AS context
  FROM valid JOIN src USING ({on})),
counted AS (
  SELECT lined.*, rules.* EXCLUDE (ord),
    list_filter(keywords, lambda k: contains(lower(context), k)) AS found FROM lined JOIN rules USING (ord)),
rated AS (
  SELECT *, least(99, greatest(1, base + 6 * len(found)
      + CASE WHEN regexp_matches(context, '[=:]')
              AND regexp_matches(context, '(?i)key|token|secret|authorization|password|bearer') THEN 8 ELSE 0 END
      + CASE WHEN category = 'secret' AND length(m) >= 24 THEN 4 ELSE 0 END
      + CASE WHEN captures THEN 4 ELSE 0 END)) AS conf FROM counted),
scored AS (
  SELECT *, CASE WHEN category = 'secret' THEN CASE WHEN conf >= 90 THEN 'critical' ELSE 'high' END
                 WHEN conf >= 82 THEN 'high' ELSE 'medium' END AS sev,
    CASE WHEN conf >= 80 THEN 'high' WHEN conf >= 60 THEN 'medium' ELSE 'low' END AS conf_label,
    trim(regexp_replace(m, '\s+', ' ', 'g')) AS snippet,
    rule_id || ':' || trim(regexp_replace(m, '\s+', ' ', 'g')) AS fingerprint,
    array_to_string(list_filter([
      explanation,
      CASE WHEN len(found) > 0 THEN 'Nearby context references "' || found[1]
        || '", which increases confidence that this is live data.' END,
      CASE WHEN length(m) >= 24 THEN
        'The match length is long enough to look like a real credential rather than a short placeholder.' END,
      CASE WHEN conf >= 90 THEN
        'Confidence is high enough that the scanner treats this as likely production-sensitive.' END
    ], lambda x: x IS NOT NULL)[1:3], '|') AS why
  FROM rated)"""


IPV4 = (
    r"(regexp_matches(m, '\b\d{1,3}(?:\.\d{1,3}){3}\b') AND len(list_filter(string_split("
    r"regexp_extract(m, '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 1), '.'), lambda x: TRY_CAST(x AS INTEGER) > 255)) = 0)"
)
PHONE_OK = rf"length(regexp_replace(m, '\D', '', 'g')) BETWEEN 10 AND 15 AND NOT {IPV4}"


def resolved(
    src: str, keys: str, rules: Rules | None = None, keep: str = "conf >= 58", joins: str = "",
) -> str:
    """CTEs up to ``f``: the findings left after filters and overlap resolution."""
    return f"""{scored(src, keys, rules)},
kept AS (SELECT scored.* FROM scored {joins} WHERE {keep}),
weighed AS (
  SELECT *, CASE sev WHEN 'critical' THEN 2000 WHEN 'high' THEN 1000 ELSE 100 END + conf + e - s AS score FROM kept),
listed AS (
  SELECT {keys}, list(struct_pack(s := s, e := e, o := ord, w := score) ORDER BY s, score DESC, ord) AS l
  FROM weighed GROUP BY {keys}),
folded AS (
  SELECT {keys}, list_reduce(list_transform(l, lambda x: [x]), lambda a, x:
    CASE WHEN x[1].s >= a[len(a)].e THEN list_concat(a, x)
         WHEN x[1].w > a[len(a)].w THEN list_concat(list_slice(a, 1, len(a) - 1), x)
         ELSE a END) AS l FROM listed),
winner AS (SELECT {keys}, unnest(l, recursive := true) FROM folded),
f AS (SELECT k.* FROM kept k JOIN winner w
  ON k.s = w.s AND k.ord = w.o AND {" AND ".join(f"k.{c} = w.{c}" for c in keys.split(", "))})"""


def finding_columns(keys: str) -> str:
    return (
        f"{keys}, rule_id, label, category, sev AS severity, s AS start_pos, e AS end_pos, m AS match, "
        "CAST(conf AS BIGINT) AS confidence, conf_label AS confidence_label"
    )


def partial_mask(value: str) -> str:
    c = rf"trim(regexp_replace({value}, '\s+', ' ', 'g'))"
    return (
        f"CASE WHEN length({c}) <= 6 THEN left({c}, 1) || '***' "
        f"ELSE left({c}, 4) || repeat('*', greatest(4, length({c}) - 6)) || right({c}, 2) END"
    )


def mask_snippet(value: str) -> str:
    c = rf"trim(regexp_replace({value}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({c}) <= 10 THEN left({c}, 2) || '...' ELSE left({c}, 6) || '...' || right({c}, 4) END"


def escape_html(value: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        value = f"replace({value}, '{raw}', '{entity}')"
    return value


def rewritten(keys: str, stand_in: str, escape: bool = False) -> str:
    """CTE ``rewritten``: every ``src`` text rebuilt from ``f`` with stand-ins."""
    wrap = escape_html if escape else (lambda x: x)
    return f"""
bit AS (
  SELECT f.*, {stand_in} AS stand_in, coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s), 0) AS from_pos FROM f),
joined AS (
  SELECT {keys}, string_agg({wrap("substr(text, from_pos + 1, s - from_pos)")} || stand_in, '' ORDER BY s) AS front,
    max(e) AS last_end FROM bit JOIN src USING ({keys}) GROUP BY {keys}),
rewritten AS (
  SELECT src.*, coalesce(front, '') || {wrap("substr(text, coalesce(last_end, 0) + 1)")} AS new_text
  FROM src LEFT JOIN joined USING ({keys}))"""

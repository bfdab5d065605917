"""ECMAScript regex syntax expressed in the java.util.regex dialect Spark uses.

Rules and user patterns are written in the ECMAScript dialect.  The two
dialects agree on almost everything; this module rewrites the handful of
constructs whose meaning differs (word boundaries, line anchors, white space,
the dot, class syntax and a few escapes).
"""

from __future__ import annotations

import re

from leakscan.functions.text import JS_SPACE_CLASS

_EOL = r"\n\r\u2028\u2029"
_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NOT_WORD_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")
_SHARED_LETTER_ESCAPES = "dDwWtnrfcxuk"


def sanitize_flags(flags: str) -> str:
    return "".join(dict.fromkeys(f for f in flags if f in "dgimsuy"))


def to_java(pattern: str, flags: str = "") -> str:
    """The Java pattern that matches what the ECMAScript one matches."""
    out: list[str] = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            piece, used = _escape(pattern, i, flags, in_class)
            out.append(piece)
            i += used
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":
                ch = "\\" + ch
            out.append(ch)
        elif pattern.startswith("[^]", i):
            out.append("(?s:.)")
            i += 2
        elif pattern.startswith("[]", i):
            out.append("(?!)")
            i += 1
        elif ch == "[":
            in_class = True
            out.append("[")
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
        elif ch == ".":
            out.append("(?s:.)" if "s" in flags else f"[^{_EOL}]")
        elif ch == "^":
            out.append(rf"(?:\A|(?<=[{_EOL}]))" if "m" in flags else r"\A")
        elif ch == "$":
            out.append(rf"(?=[{_EOL}]|\z)" if "m" in flags else r"\z")
        elif ch == "{" and not _QUANTIFIER.match(pattern, i):
            out.append(r"\{")
        else:
            out.append(ch)
        i += 1
    prefix = r"\G" if "y" in flags else ""
    if "i" in flags:
        # Unicode folding only where the pattern can need it.
        prefix = ("(?iu)" if "u" in flags or not pattern.isascii() else "(?i)") + prefix
    return prefix + "".join(out)


def _escape(pattern: str, i: int, flags: str, in_class: bool) -> tuple[str, int]:
    """Translate the escape at ``i``; returns the Java text and its source length."""
    ch = pattern[i + 1]
    if ch == "s":
        return (JS_SPACE_CLASS if in_class else f"[{JS_SPACE_CLASS}]"), 2
    if ch == "S":
        return f"[^{JS_SPACE_CLASS}]", 2
    if ch == "b":
        if in_class:
            return r"\x08", 2
        nxt = pattern[i + 2 : i + 3]
        # Before a literal word character the two-sided test is not needed.
        return (r"(?<!\w)" if re.match(r"[A-Za-z0-9_]", nxt) else _WORD_EDGE), 2
    if ch == "B" and not in_class:
        return _NOT_WORD_EDGE, 2
    if ch == "v":
        return r"\x0B", 2
    if ch == "0":
        return r"\x00", 2
    if ch == "u" and "u" in flags and pattern.startswith("{", i + 2):
        end = pattern.find("}", i)
        if end > 0:
            return rf"\x{pattern[i + 2 : end + 1]}", end + 1 - i
    if ch in "pP" and "u" in flags:
        return "\\" + ch, 2
    if ch.isalpha() and ch not in _SHARED_LETTER_ESCAPES:
        return ch, 2
    return "\\" + ch, 2


def quote(literal: str) -> str:
    """A pattern that matches the literal text."""
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", literal)


def split_capture(pattern: str) -> tuple[str, str, str]:
    """Cut a pattern with one capturing group into before, group and after."""
    depth, start, in_class, i = 0, -1, False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            if start < 0 and pattern[i + 1 : i + 2] != "?":
                start, depth = i, 0
            depth += 1
        elif ch == ")":
            depth -= 1
            if start >= 0 and depth == 0:
                return pattern[:start], pattern[start + 1 : i], pattern[i + 1 :]
        i += 1
    raise ValueError(f"no capturing group in {pattern!r}")


def literal_prefix(pattern: str) -> str:
    """Text every match has to start with, or '' when that is not evident."""
    if "|" in pattern:
        return ""
    body = pattern.removeprefix(r"\b")
    literal = re.match(r"[A-Za-z0-9_@:/=-]*", body).group()
    follow = body[len(literal) : len(literal) + 1]
    # A quantifier after the run belongs to its last character.
    return literal[:-1] if follow and follow in "*?{+" else literal

"""User patterns: checked as ECMAScript, and written so that Java can run them.

A pattern that ECMAScript would not compile is refused, and so are the few that
Java can not run as meant: references to a group that may not have taken part,
and repeats without bound of a group whose rounds differ in length or branch,
for which Java needs stack space per round.  Branches of one character each
are no such group: they become a class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from leakscan.functions.regex import _escape, to_java

MOST_ROUNDS = 100  # of a branching group, for which the stack always suffices
SYNTAX = "^$\\.*+?()[]{}|/"


class Refused(ValueError):
    """Why a pattern is not used."""


@dataclass
class Node:
    java: str
    width: int | None = 0  # characters it takes, if always the same
    plain: bool = True  # no alternatives and no choice of length inside
    members: str | None = None  # what a class would list for it, if it takes one character
    groups: list[int] = field(default_factory=list)  # capturing groups that have always taken part


def translate(pattern: str, flags: str = "") -> str:
    """The Java pattern, or :class:`Refused` with a reason."""
    if len(set(flags)) != len(flags):
        raise Refused("repeated flag")
    node = _Parser(pattern, flags).whole()
    prefix = r"\G" if "y" in flags else ""
    if "i" in flags:
        prefix = ("(?iu)" if "u" in flags or not pattern.isascii() else "(?i)") + prefix
    return prefix + node.java


def reason(pattern: str | None, flags: str | None = "") -> str | None:
    """Why a pattern is refused, or None if it is not."""
    try:
        translate(pattern or "", flags or "")
    except Refused as error:
        return str(error)
    return None


class _Parser:
    def __init__(self, text: str, flags: str):
        self.text, self.flags, self.at = text, flags, 0
        self.strict = "u" in flags
        opened = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", lambda m: " " * len(m.group()), text, flags=re.S)
        self.names = re.findall(r"\(\?<([^=!>][^>]*)>", opened)
        self.total = len(re.findall(r"\((?!\?)|\(\?<(?![=!])", opened))
        self.count = 0
        self.index: dict[str, int] = {}

    def whole(self) -> Node:
        node = self.alternatives([])
        if self.at < len(self.text):
            raise Refused("unmatched )")
        return node

    def ahead(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.ahead(token):
            self.at += len(token)
            return True
        return False

    def alternatives(self, known: list[int]) -> Node:
        branches = [self.sequence(known)]
        while self.take("|"):
            branches.append(self.sequence(known))
        if len(branches) == 1:
            return branches[0]
        java = "|".join(b.java for b in branches)
        if all(b.members is not None for b in branches):
            members = "".join(b.members for b in branches)
            return Node(f"[{members}]", 1, True, members)
        same = {b.width for b in branches}
        return Node(java, same.pop() if len(same) == 1 else None, False)

    def sequence(self, known: list[int]) -> Node:
        parts: list[Node] = []
        sure = list(known)
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self.term(sure)
            sure += part.groups
            parts.append(part)
        width = 0
        for part in parts:
            width = None if width is None or part.width is None else width + part.width
        own = [g for part in parts for g in part.groups]
        members = parts[0].members if len(parts) == 1 else None
        return Node("".join(p.java for p in parts), width, all(p.plain for p in parts), members, own)

    def term(self, known: list[int]) -> Node:
        ch = self.text[self.at]
        if ch in "^$":
            self.at += 1
            return self.unquantified(Node(to_java(ch, self.flags.replace("i", "").replace("y", ""))))
        if ch == "(":
            return self.group(known)
        if ch == "[":
            node = self.char_class()
        elif ch == "\\":
            node = self.escape(known)
            if node.width == 0 and node.members is None and node.java.startswith("(?") and "\\w" in node.java:
                return self.unquantified(node)
        elif ch in "*+?":
            raise Refused("nothing to repeat")
        elif ch == "{" and (self.strict or re.match(r"\{\d+(?:,\d*)?\}", self.text[self.at :])):
            raise Refused("nothing to repeat")
        elif ch in "]}" and self.strict:
            raise Refused(f"lone {ch}")
        else:
            self.at += 1
            java = to_java(ch, self.flags.replace("i", "").replace("y", ""))
            members = ch if ch.isalnum() or not ch.isascii() else "\\" + ch
            if ch == ".":
                members = "\\x{0}-\\x{10FFFF}" if "s" in self.flags else java
            node = Node(java if ch not in "}]" else "\\" + ch, 1, True, members)
        return self.quantified(node)

    def unquantified(self, node: Node) -> Node:
        if self.quantifier() is not None:
            raise Refused("nothing to repeat")
        return node

    def quantifier(self) -> tuple[str, int, float] | None:
        found = re.compile(r"([*+?]|\{(\d+)(?:(,)(\d*))?\})(\??)").match(self.text, self.at)
        if found is None:
            if self.strict and self.ahead("{"):
                raise Refused("incomplete quantifier")
            return None
        self.at = found.end()
        sign, low, comma, high, _ = found.groups()
        least = {"*": 0, "+": 1, "?": 0}.get(sign[0], int(low or 0))
        most = {"*": float("inf"), "+": float("inf"), "?": 1}.get(sign[0])
        if most is None:
            most = float(high) if high else float("inf") if comma else least
        if most < least:
            raise Refused("numbers out of order in a quantifier")
        if least >= 2**31 or most != float("inf") and most >= 2**31:
            raise Refused("quantifier too large")
        return found.group(), least, most

    def quantified(self, node: Node, group: bool = False) -> Node:
        found = self.quantifier()
        if found is None:
            return node
        text, least, most = found
        if group and most > MOST_ROUNDS and not (node.plain and node.width is not None):
            raise Refused("repeats without bound a group that branches or varies in length")
        fixed = least == most
        width = None if not fixed or node.width is None else int(node.width * least)
        return Node(node.java + text, width, node.plain and fixed, None, node.groups if least else [])

    def group(self, known: list[int]) -> Node:
        for opening in ("(?=", "(?!", "(?<=", "(?<!"):
            if self.take(opening):
                body = self.closed(known)
                node = Node(f"{opening}{body.java})", 0, body.plain, None, body.groups if "!" not in opening else [])
                if opening[2] == "<" or self.strict:
                    return self.unquantified(node)
                return self.quantified(node, True)
        if self.take("(?:"):
            body = self.closed(known)
            java = body.java if body.members is not None else f"(?:{body.java})"
            return self.quantified(Node(java, body.width, body.plain, body.members, body.groups), body.members is None)
        number = self.count = self.count + 1
        if self.take("(?<"):
            name = re.compile(r"[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*").match(self.text, self.at)
            if name is None or not self.text.startswith(">", name.end()):
                raise Refused("invalid group name")
            if name.group() in self.index:
                raise Refused("repeated group name")
            self.index[name.group()] = number
            self.at = name.end() + 1
        elif self.ahead("(?"):
            raise Refused("invalid group")
        else:
            self.at += 1
        body = self.closed(known)
        return self.quantified(Node(f"({body.java})", body.width, body.plain, None, [*body.groups, number]), True)

    def closed(self, known: list[int]) -> Node:
        body = self.alternatives(known)
        if not self.take(")"):
            raise Refused("unterminated group")
        return body

    def char_class(self) -> Node:
        start = self.at
        found = re.compile(r"\[(\^?)((?:\\.|[^\]\\])*)\]", re.S).match(self.text, self.at)
        if found is None:
            raise Refused("unterminated class")
        self.at = found.end()
        self.ranges(found.group(2))
        java = to_java(self.text[start : self.at], self.flags.replace("i", "").replace("y", ""))
        if not found.group(2):
            return Node(java, 1, True, "\\x{0}-\\x{10FFFF}" if found.group(1) else None)
        return Node(java, 1, True, java if found.group(1) else java[1:-1])

    def ranges(self, body: str) -> None:
        """Refuse ranges out of order, and escapes that a class does not know."""
        atoms = re.findall(r"\\u\{[0-9A-Fa-f]+\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\c[A-Za-z]|\\[pP]\{[^}]*\}|\\.|.", body, re.S)
        values = []
        for atom in atoms:
            if self.strict and atom[0] == "\\" and len(atom) == 2 and atom[1] not in SYNTAX + "dDwWsSbtnvfr0-":
                raise Refused("invalid escape")
            values.append(_value(atom))
        k = 0
        while k + 2 < len(atoms):
            if atoms[k + 1] != "-":
                k += 1
                continue
            a, b = values[k], values[k + 2]
            if (a is None or b is None) and self.strict:
                raise Refused("invalid range in a class")
            if a is not None and b is not None and a > b:
                raise Refused("range out of order in a class")
            k += 3

    def escape(self, known: list[int]) -> Node:
        if self.at + 1 >= len(self.text):
            raise Refused("\\ at the end")
        ch = self.text[self.at + 1]
        digits = re.compile(r"\\([1-9]\d*)").match(self.text, self.at)
        if digits and (self.strict or int(digits.group(1)) <= self.total):
            if int(digits.group(1)) > self.total:
                raise Refused("no such group")
            self.at = digits.end()
            return self.reference(int(digits.group(1)), known)
        if ch == "k" and (self.names or self.strict):
            named = re.compile(r"\\k<([^>]*)>").match(self.text, self.at)
            if named is None or named.group(1) not in self.names:
                raise Refused("no such group")
            self.at = named.end()
            number = self.index.get(named.group(1))
            return Node("(?:)") if number is None else self.reference(number, known)
        if digits:
            octal = re.compile(r"\\([0-3]?[0-7]{1,2}|[89])").match(self.text, self.at)
            self.at = octal.end()
            code = octal.group(1)
            java = code if code in "89" else f"\\x{{{int(code, 8):x}}}"
            return Node(java, 1, True, java)
        if self.strict:
            valid = ch in SYNTAX + "dDwWsSbBtnvfr0" or re.match(
                r"\\(?:c[A-Za-z]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]+\}|[pP]\{[^}]+\})", self.text[self.at :]
            )
            if not valid:
                raise Refused("invalid escape")
        whole = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c[A-Za-z]|" + (r"u\{[0-9A-Fa-f]+\}|[pP]\{[^}]+\}|" if self.strict else "") + r".)", re.S).match(self.text, self.at).group()
        self.at += len(whole)
        if len(whole) == 2 and ch in "xuc":
            # Without digits these stand for themselves.
            return Node(ch if ch != "c" else r"\\c", 1, True, ch if ch != "c" else None)
        piece, _ = _escape(whole + self.text[self.at : self.at + 1], 0, self.flags, False)
        if len(whole) > 2 and not whole.startswith(("\\u{", "\\p", "\\P")):
            piece = whole
        elif whole.startswith(("\\p", "\\P")):
            piece = _property(whole)
        if ch in "bB":
            return Node(piece, 0)
        return Node(piece, 1, True, piece)

    def reference(self, number: int, known: list[int]) -> Node:
        if number > self.count or number not in known and self.open(number):
            return Node("(?:)")  # not yet closed: it stands for nothing
        if number not in known:
            raise Refused("refers to a group that may not have taken part")
        node = Node(f"\\{number}", None, False)
        repeated = self.quantified(node)
        # Digits that follow must not be read as part of the number.
        return Node(f"{node.java}(?:)", None, False) if repeated is node else repeated

    def open(self, number: int) -> bool:
        """Whether the group is one that this place lies in."""
        depth, stack, count = 0, [], 0
        k = 0
        while k < self.at:
            if self.text[k] == "\\":
                k += 2
                continue
            if self.text[k] == "[":
                k = re.compile(r"\[(?:\\.|[^\]\\])*\]", re.S).match(self.text, k).end()
                continue
            if self.text[k] == "(":
                captures = not self.text.startswith("(?", k) or re.match(r"\(\?<[^=!]", self.text[k:])
                count += bool(captures)
                stack.append(count if captures else 0)
            elif self.text[k] == ")":
                stack.pop()
            k += 1
        return number in stack


def _value(atom: str) -> int | None:
    """The code point an atom of a class stands for; None for a set."""
    if atom[0] != "\\":
        return ord(atom)
    if atom[1] in "dDwWsSpP":
        return None
    if atom[1] in "xu" and len(atom) > 2:
        return int(atom[2:].strip("{}"), 16)
    if atom[1] == "c" and len(atom) > 2:
        return ord(atom[2]) % 32
    return {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "b": 8, "0": 0}.get(atom[1], ord(atom[1]))


def _property(escape: str) -> str:
    """Unicode properties under the names Java has for them."""
    sign, name = escape[:2], escape[3:-1]
    key, _, value = name.partition("=")
    if value:
        if key in ("Script", "sc", "Script_Extensions", "scx"):
            return f"{sign}{{Is{value}}}"
        if key in ("General_Category", "gc"):
            return f"{sign}{{{value}}}"
        raise Refused("unknown property")
    long = {"Letter": "L", "Number": "N", "Punctuation": "P", "Symbol": "S", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Decimal_Number": "Nd"}
    if name in long or re.fullmatch(r"[LMNPSZC][a-z&]?", name):
        return f"{sign}{{{long.get(name, name)}}}"
    return f"{sign}{{Is{name}}}"

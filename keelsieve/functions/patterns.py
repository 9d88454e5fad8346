"""Rule patterns in RE2's syntax, read once and written for the engine that runs them.

Matching runs on byte projections, which are ASCII. What means something else to the JVM's
engine is rewritten (line ends, dots, POSIX classes, group names); what RE2 refuses is refused.
A pattern whose wanted group has a fixed place in it is given marks around that group, so that
one replacement finds all spans inside the JVM; any other group is left to Python's engine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Marks before a match, before and after the wanted group: characters that a byte projection never holds.
MARKS = ("\ue000", "\ue001", "\ue002")
_END = r"(?![\s\S])"
# POSIX classes as members of a class.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0b\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_QUANTIFIER = re.compile(r"[*+?]\??|\{(\d+)(?:,(\d*))?\}\??")


@dataclass
class Node:
    """A group, or the whole pattern: where it opens and closes among the pieces."""

    open: int
    number: int = 0
    close: int = -1
    branches: bool = False
    repeated: bool = False
    children: list = field(default_factory=list)


@dataclass
class Pattern:
    pieces: list[str]
    flags: str
    root: Node
    groups: int
    #: Group number by name.
    names: dict[str, int]

    def plain(self) -> str:
        """For Python's engine."""
        return (f"(?{self.flags})" if self.flags else "") + "".join(self.pieces)

    def path(self, group: int) -> list[Node] | None:
        """The nodes from the whole pattern to a group that always takes part in a match, exactly once; None for any other."""
        stack = [[self.root]]
        while stack:
            way = stack.pop()
            if way[-1].number == group:
                return None if any(n.repeated for n in way[1:]) or any(n.branches for n in way[:-1]) else way
            stack += [[*way, c] for c in way[-1].children]
        return None

    def marked(self, group: int) -> tuple[str, str] | None:
        """Pattern and replacement for the JVM's engine that set MARKS around a group; None if its place is not fixed."""
        before, opened, closed = MARKS
        head = f"(?{self.flags})" if self.flags else ""
        if group == 0:
            return f"{head}({_java(self.pieces)})", f"{before}{opened}$1{closed}"
        way = self.path(group)
        if way is None:
            return None
        pieces = list(self.pieces)
        left, right = [], []
        for depth, (outer, inner) in enumerate(zip(way, way[1:])):
            first, last = outer.open + 1, (outer.close if outer.close >= 0 else len(self.pieces))
            for name, a, b in ((f"kp{depth}", first, inner.open), (f"ks{depth}", inner.close + 1, last)):
                # the pieces between two marks become a group of their own
                if b > a:
                    pieces[a] = f"(?P<{name}>" + pieces[a]
                    pieces[b - 1] += ")"
            left += [f"kp{depth}"] if inner.open > first else []
            right = ([f"ks{depth}"] if last > inner.close + 1 else []) + right
        at = way[-1].open
        pieces[at] = pieces[at][: pieces[at].rindex("(")] + "(?P<kv>"
        number = re.compile(head + "".join(pieces)).groupindex
        sets = lambda names: "".join(f"${number[n]}" for n in names)
        return head + _java(pieces), f"{before}{sets(left)}{opened}${number['kv']}{closed}{sets(right)}"


def _java(pieces: list[str]) -> str:
    return re.sub(r"\(\?P<\w+>", "(", "".join(pieces))


def _class(pattern: str, i: int) -> tuple[str, int]:
    """A bracket class from its opening bracket on, and where it ends."""
    out, start = ["["], i
    i += 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while True:
        if i >= len(pattern):
            raise ValueError(f"missing ] after {pattern[start : start + 10]!r}")
        c = pattern[i]
        if c == "]" and not first:
            return "".join([*out, "]"]), i + 1
        first = False
        if c == "[":
            m = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)
            if m:
                if m[1] or m[2] not in _POSIX:
                    raise ValueError(f"unknown class {m[0]}")
                out.append(_POSIX[m[2]])
                i = m.end()
                continue
            out.append(r"\[")
            i += 1
        elif c == "\\":
            two = pattern[i : i + 2]
            if len(two) < 2:
                raise ValueError("trailing backslash")
            if two[1] in "pPbBAzZ":
                raise ValueError(f"{two} is not taken inside a class")
            out.append(r"\t\n\f\r " if two == r"\s" else two)
            i += 2
        elif c == "&" and pattern[i : i + 2] == "&&":
            out.append(r"\&")
            i += 1
        else:
            out.append(r"\]" if c == "]" else c)
            i += 1


def read(pattern: str) -> Pattern:
    """ValueError for what RE2 refuses (look-around, back-references, possessive or stacked repeats) and for what has no counterpart here."""
    if not pattern.isascii():
        raise ValueError("a pattern has to be ASCII: texts are matched as bytes")
    m = re.match(r"\(\?([imsU]+)\)", pattern)
    flags, i = (m[1], m.end()) if m else ("", 0)
    if "U" in flags:
        raise ValueError("the flag U is not taken")
    multi, dot_all = "m" in flags, "s" in flags
    flags = "i" if "i" in flags else ""
    pieces: list[str] = []
    root = Node(-1)
    stack = [root]
    number, names = 0, {}
    repeatable = False
    while i < len(pattern):
        c = pattern[i]
        q = _QUANTIFIER.match(pattern, i)
        if q and (c != "{" or repeatable):
            if not repeatable:
                raise ValueError(f"nothing to repeat at {q[0]!r}" if not pieces or pieces[-1][-1:] not in "*+?}" else f"invalid nested repeat {q[0]!r}")
            if q[1] is not None and (int(q[1]) > 1000 or (q[2] and (int(q[2]) > 1000 or int(q[2]) < int(q[1])))):
                raise ValueError(f"invalid repeat count {q[0]!r}")
            if stack[-1].children and stack[-1].children[-1].close == len(pieces) - 1:
                stack[-1].children[-1].repeated = True
            pieces[-1] += q[0]
            repeatable, i = False, q.end()
            continue
        repeatable = True
        if c == "(":
            m = re.compile(r"\((?:\?(?:P?<([A-Za-z_]\w*)>|([is]*):))?").match(pattern, i)
            if pattern[i + 1 : i + 2] == "?" and not (m[1] or m[2] is not None):
                raise ValueError(f"unsupported group {pattern[i : i + 4]!r}")
            if m[2] and "s" in m[2]:
                raise ValueError("the flag s is only taken for the whole pattern")
            node = Node(len(pieces))
            if m[2] is None:
                number += 1
                node.number = number
                if m[1]:
                    if m[1] in names:
                        raise ValueError(f"group {m[1]!r} is named twice")
                    names[m[1]] = number
            stack[-1].children.append(node)
            stack.append(node)
            pieces.append(f"(?{m[2]}:" if m[2] is not None else f"(?P<{m[1]}>" if m[1] else "(")
            i, repeatable = m.end(), False
        elif c == ")":
            if len(stack) == 1:
                raise ValueError("unexpected )")
            stack.pop().close = len(pieces)
            pieces.append(")")
            i += 1
        elif c == "|":
            stack[-1].branches = True
            pieces.append("|")
            i, repeatable = i + 1, False
        elif c == "[":
            out, i = _class(pattern, i)
            pieces.append(out)
        elif c == ".":
            pieces.append(r"[\s\S]" if dot_all else r"[^\n]")
            i += 1
        elif c == "^":
            pieces.append(r"(?<![^\n])" if multi else r"(?<![\s\S])")
            i += 1
        elif c == "$":
            pieces.append(r"(?![^\n])" if multi else _END)
            i += 1
        elif c == "\\":
            two = pattern[i : i + 2]
            if len(two) < 2:
                raise ValueError("trailing backslash")
            if two == r"\Q":
                stop = pattern.find(r"\E", i)
                stop = len(pattern) if stop < 0 else stop
                pieces += [re.escape(x) for x in pattern[i + 2 : stop]]
                i = stop + 2
                continue
            if two[1] in "123456789" or two[1] in "kgGhHRXZCpPuUoceE":
                raise ValueError(f"{two} is not taken")
            if two == r"\x":
                m = re.compile(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})").match(pattern, i)
                if not m or int(m[1] or m[2], 16) > 127:
                    raise ValueError(f"bad escape {pattern[i : i + 6]!r}")
                pieces.append(f"\\x{int(m[1] or m[2], 16):02x}")
                i = m.end()
                continue
            pieces.append({r"\A": r"(?<![\s\S])", r"\z": _END, r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\a": r"\x07", r"\v": r"\x0b"}.get(two, two))
            i += 2
        else:
            pieces.append("\\" + c if c in "{}" else c)
            i += 1
    if len(stack) > 1:
        raise ValueError("missing )")
    return Pattern(pieces, flags, root, number, names)


def matches_nothing(p: Pattern) -> bool:
    """Whether a pattern matches the empty text, so that matches of no length must be told apart."""
    return re.compile(p.plain()).search("") is not None

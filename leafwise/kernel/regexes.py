"""The pattern dialect of schemas, translated to a regular expression that Python and Java read alike.

Dialect: literals, ``.``, groups, alternation, ``? * + {m} {m,} {m,n}``, classes, ``^`` and ``$`` as anchors of the whole
pattern, and escapes of the syntax characters and of f n r t v. A quantifier after a quantifier applies to what it
follows. A pattern that can match nothing matches a non-empty text only where it takes a character of it.
"""

from __future__ import annotations

import re
from functools import lru_cache

_ESCAPED = {"f": "\\f", "n": "\\n", "r": "\\r", "t": "\\t", "v": "\\x0B", "b": "\\x08"}
_SYNTAX = frozenset("^$|()?*+.[]{}\\")
_COUNT = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")


class PatternError(ValueError):
    pass


def _literal(c: str) -> str:
    return re.escape(c) if c.isascii() else c


class _Translator:
    def __init__(self, pattern: str):
        self.text, self.at, self.begin, self.end = pattern, 0, False, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self, depth: int) -> str:
        branches = [self.sequence(depth)]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.sequence(depth))
        if len(branches) > 1 and "" in branches:
            raise PatternError("an alternative is empty")
        return "|".join(branches)

    def sequence(self, depth: int) -> str:
        parts: list[str] = []
        while (c := self.peek()) and c != "|" and not (c == ")" and depth):
            if c == "^":
                self.begin, self.at = True, self.at + 1
            elif c == "$":
                self.end, self.at = True, self.at + 1
            elif c in "?*+" or c == "{":
                if not parts:
                    raise PatternError("nothing to repeat")
                parts[-1] = f"(?:{parts[-1]}{self.quantifier()})"
            else:
                parts.append(self.atom(depth))
        return "".join(parts)

    def quantifier(self) -> str:
        if (c := self.peek()) != "{":
            self.at += 1
            return c
        m = _COUNT.match(self.text, self.at)
        if not m or (m[3] and int(m[3]) < int(m[1])) or (m[1] == "0" and m[3] == "0"):
            raise PatternError("bad count")
        self.at = m.end()
        return m[0]

    def atom(self, depth: int) -> str:
        c = self.peek()
        self.at += 1
        if c == "(":
            body = self.alternatives(depth + 1)
            if self.peek() != ")" or not body:
                raise PatternError("bad group")
            self.at += 1
            return f"(?:{body})"
        if c == ")":
            raise PatternError("group is not open")
        if c == "[":
            return self.characters()
        if c == ".":
            return "[\\s\\S]"
        return self.escape() if c == "\\" else _literal(c)

    def escape(self) -> str:
        c = self.peek()
        self.at += 1
        if c and c in _SYNTAX:
            return "\\" + c
        if c in _ESCAPED and c != "b":
            return _ESCAPED[c]
        raise PatternError("unknown escape")

    def characters(self) -> str:
        out = "["
        if self.peek() == "^":
            out, self.at = "[^", self.at + 1
        first = True
        while True:
            c = self.peek()
            if not c:
                raise PatternError("class is not closed")
            self.at += 1
            if c == "]" and not first:
                return out + "]"
            first = False
            if c == "\\":
                if self.peek() == "b":
                    self.at += 1
                    out += "\\x08"
                else:
                    out += self.escape()
            elif c == "-" and out not in ("[", "[^") and self.peek() not in ("]", ""):
                out += "-"
            else:
                out += "\\" + c if c in "-[]^&~|\\" else c


@lru_cache(4096)
def translate(pattern: str) -> tuple[str, bool]:
    """(regular expression to search with, whether it can match nothing); raises PatternError."""
    t = _Translator(pattern)
    body = t.alternatives(0)
    if t.at < len(pattern):
        raise PatternError("group is not open")
    try:
        nullable = re.fullmatch(body, "") is not None
    except re.error as e:
        raise PatternError(str(e)) from None
    core = f"(?:{body})"
    if nullable:  # the rest of the text before and after the match must differ
        core = f"(?=([\\s\\S]*)$(?![\\s\\S])){core}(?!\\1$(?![\\s\\S]))"
    return ("^" if t.begin else "") + core + ("$(?![\\s\\S])" if t.end else ""), nullable


@lru_cache(4096)
def _compiled(pattern: str) -> tuple[re.Pattern, bool]:
    expression, nullable = translate(pattern)
    return re.compile(expression), nullable


def search(pattern: str, text: str) -> bool:
    expression, nullable = _compiled(pattern)
    return nullable and not text or expression.search(text) is not None

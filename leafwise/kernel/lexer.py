"""A strict JSON parser with error codes and byte offsets.

Values: None, bool, int, float, str, list and ``Obj`` (an ordered list of pairs that keeps duplicate names). Well-formed
texts take the interpreter's own scanner; whatever that cannot judge exactly goes to the explicit-stack parser below,
which has no depth limit.
"""

from __future__ import annotations

import json
import math
import re

from leafwise.options import ParseFlags

# Error codes from 0 with their messages.
PARSE_ERRORS = [
    ("None", "No error."),
    ("DocumentEmpty", "The document is empty."),
    ("DocumentRootNotSingular", "The document root must not be followed by other values."),
    ("ValueInvalid", "Invalid value."),
    ("ObjectMissName", "Missing a name for object member."),
    ("ObjectMissColon", "Missing a colon after a name of object member."),
    ("ObjectMissCommaOrCurlyBracket", "Missing a comma or '}' after an object member."),
    ("ArrayMissCommaOrSquareBracket", "Missing a comma or ']' after an array element."),
    ("StringUnicodeEscapeInvalidHex", "Incorrect hex digit after \\u escape in string."),
    ("StringUnicodeSurrogateInvalid", "The surrogate pair in string is invalid."),
    ("StringEscapeInvalid", "Invalid escape character in string."),
    ("StringMissQuotationMark", "Missing a closing quotation mark in string."),
    ("StringInvalidEncoding", "Invalid encoding in string."),
    ("NumberTooBig", "Number too big to be stored in double."),
    ("NumberMissFraction", "Miss fraction part in number."),
    ("NumberMissExponent", "Miss exponent in number."),
    ("Termination", "Terminate parsing due to Handler error."),
    ("UnspecificSyntaxError", "Unspecific syntax error."),
]
CODES = {name: k for k, (name, _) in enumerate(PARSE_ERRORS)}
MESSAGES = dict(PARSE_ERRORS)
DEFAULT = ParseFlags()


class Obj(list):
    """An object: (name, value) pairs in order."""

    def find(self, name: str):
        """(found, value) of the first member of that name."""
        for k, v in self:
            if k == name:
                return True, v
        return False, None

    def index_of(self, name: str) -> int:
        for i, (k, _) in enumerate(self):
            if k == name:
                return i
        return -1


class Raw(str):
    """A number's own text."""


class ParseError(ValueError):
    def __init__(self, code: str, position: int):
        super().__init__(MESSAGES[code])
        self.code, self.position = code, position


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_SCAN = re.compile(r'[^\s",:{}\[\]]+')
#: What the interpreter's scanner might not judge exactly: surrogates and integers of over 64 bits.
UNSURE = r"\\u[dD][89a-fA-F]|[0-9]{19}"
_UNSURE = re.compile(UNSURE)
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_HEX = re.compile("[0-9a-fA-F]{4}")


class _Unsure(Exception):
    pass


def _float(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise _Unsure
    return value


def _constant(_: str):
    raise _Unsure


_FAST = json.JSONDecoder(object_pairs_hook=Obj, parse_float=_float, parse_constant=_constant)
#: Where documents end, when their values are not asked for.
_PLACES = json.JSONDecoder(parse_float=_float, parse_constant=_constant)
_ONE_BY_ONE = ParseFlags(stop_when_done=True)
_NUMBER_GOES_ON = frozenset(".eE")


def number(text: str, start: int) -> int | float:
    """An integer in the 64-bit ranges, else a double."""
    if "." not in text and "e" not in text and "E" not in text:
        value = int(text)
        if -(1 << 63) <= value < 1 << 64:
            return value
    value = float(text)
    if math.isinf(value):
        raise ParseError("NumberTooBig", start)
    return value


class _Parser:
    def __init__(self, text: str, flags: ParseFlags):
        self.text, self.flags, self.at = text, flags, 0

    def fail(self, code: str, at: int | None = None):
        raise ParseError(code, self.at if at is None else at)

    def space(self) -> str:
        """Skips white space (and comments); the next character, empty at the end."""
        text = self.text
        while True:
            self.at = _SPACE.match(text, self.at).end()
            here = text[self.at : self.at + 1]
            if here != "/" or not self.flags.comments:
                return here
            mark = text[self.at : self.at + 2]
            end = text.find("*/" if mark == "/*" else "\n", self.at + 2)
            if mark == "/*" and end >= 0:
                self.at = end + 2
            elif mark == "//":
                self.at = len(text) if end < 0 else end + 1
            else:
                self.fail("UnspecificSyntaxError", self.at + 1 if mark != "/*" else len(text))

    def string(self) -> str:
        text, parts = self.text, []
        self.at += 1
        while True:
            m = _PLAIN.match(text, self.at)
            parts.append(m[0])
            self.at = m.end()
            c = text[self.at : self.at + 1]
            if c == '"':
                self.at += 1
                return "".join(parts)
            if c == "\\":
                parts.append(self.escape())
            elif c in ("", "\0"):
                self.fail("StringMissQuotationMark")
            else:
                self.fail("StringInvalidEncoding")

    def hex(self, begun: int) -> int:
        m = _HEX.match(self.text, self.at)
        if not m:
            self.fail("StringUnicodeEscapeInvalidHex", begun)
        self.at += 4
        return int(m[0], 16)

    def escape(self) -> str:
        begun = self.at
        c = self.text[begun + 1 : begun + 2]
        self.at += 2
        if c in _ESCAPES and c:
            return _ESCAPES[c]
        if c == "'" and self.flags.escaped_apostrophe:
            return c
        if c != "u":
            self.fail("StringEscapeInvalid", begun)
        point = self.hex(begun)
        if 0xD800 <= point <= 0xDFFF:
            if point > 0xDBFF or self.text[self.at : self.at + 2] != "\\u":
                self.fail("StringUnicodeSurrogateInvalid", begun)
            self.at += 2
            low = self.hex(begun)
            if not 0xDC00 <= low <= 0xDFFF:
                self.fail("StringUnicodeSurrogateInvalid", begun)
            point = 0x10000 + ((point - 0xD800) << 10) + (low - 0xDC00)
        return chr(point)

    def literal(self, word: str, value):
        for c in word:
            if self.text[self.at : self.at + 1] != c:
                self.fail("ValueInvalid")
            self.at += 1
        return value

    def number(self):
        text, start = self.text, self.at
        sign = text[start] == "-"
        first = text[start + sign : start + sign + 1]
        if self.flags.nan_and_inf and first in ("N", "I"):
            self.at += sign
            if first == "N":
                value = self.literal("NaN", math.nan)
            else:
                self.literal("Inf", None)
                if text[self.at : self.at + 1] == "i":
                    self.literal("inity", None)
                value = math.inf
            return text[start : self.at] if self.flags.numbers_as_strings else -value if sign else value
        if not first.isascii() or not first.isdigit():
            self.fail("ValueInvalid", start + sign)
        m = _NUMBER.match(text, start)
        self.at = m.end()
        following = text[self.at : self.at + 1]
        if following == "." and m[1] is None and m[2] is None:
            self.fail("NumberMissFraction", self.at + 1)
        if following in ("e", "E") and m[2] is None and following:
            self.fail("NumberMissExponent", self.at + 1 + (text[self.at + 1 : self.at + 2] in ("+", "-") and text[self.at + 1 : self.at + 2] != ""))
        return m[0] if self.flags.numbers_as_strings else number(m[0], start)

    def value(self, c: str):
        """A scalar, or an empty container whose opening bracket is read."""
        if c == '"':
            return self.string()
        if c == "t":
            return self.literal("true", True)
        if c == "f":
            return self.literal("false", False)
        if c == "n":
            return self.literal("null", None)
        if c and c in "{[":
            self.at += 1
            return Obj() if c == "{" else []
        if not c:
            self.fail("ValueInvalid")
        return self.number()

    def name(self, c: str) -> str:
        if c != '"':
            self.fail("ObjectMissName")
        name = self.string()
        if self.space() != ":":
            self.fail("ObjectMissColon")
        self.at += 1
        return name

    def document(self):
        c = self.space()
        if not c:
            self.fail("DocumentEmpty")
        root = self.value(c)
        stack, opened = [], c in "{["
        node = root
        while opened or stack:
            if opened:  # node is new and empty
                c, closing = self.space(), "}" if isinstance(node, Obj) else "]"
                stack.append(node)
                opened = False
                if c == closing:
                    self.at += 1
                    stack.pop()
                    node = stack[-1] if stack else None
                    continue
            else:
                node = stack[-1]
                closing = "}" if isinstance(node, Obj) else "]"
                c = self.space()
                if c == closing:
                    self.at += 1
                    stack.pop()
                    continue
                if c != ",":
                    self.fail("ObjectMissCommaOrCurlyBracket" if closing == "}" else "ArrayMissCommaOrSquareBracket")
                self.at += 1
                c = self.space()
                if c == closing and self.flags.trailing_commas:
                    self.at += 1
                    stack.pop()
                    continue
            if closing == "}":
                name = self.name(c)
                c = self.space()
                child = self.value(c)
                node.append((name, child))
            else:
                child = self.value(c)
                node.append(child)
            if c and c in "{[":
                node, opened = child, True
        return root


def parse(text: str, flags: ParseFlags = DEFAULT):
    """(value, end in characters); raises ParseError."""
    if flags == DEFAULT and not _UNSURE.search(text):
        try:
            return _FAST.decode(text), len(text)
        except (ValueError, _Unsure, RecursionError):
            pass
    p = _Parser(text, flags)
    value = p.document()
    if not flags.stop_when_done:
        if p.space():
            p.fail("DocumentRootNotSingular")
    return value, p.at


def parse_sure(text: str):
    """The value of a text in which nothing is ``UNSURE``, by the plain flags."""
    try:
        value, end = _FAST.scan_once(text, 0)
        if end == len(text):
            return value
    except (StopIteration, ValueError, _Unsure, RecursionError):
        pass
    return parse(text)[0]


def byte_offset(text: str, position: int) -> int:
    return len(text[:position].encode("utf-8", "surrogatepass"))


def status(text: str | None, flags: ParseFlags = DEFAULT) -> dict | None:
    """Code, message, byte offset, line and column (from 1) of the error; code None at the end offset if there is none."""
    if text is None:
        return None
    try:
        code, at = "None", parse(text, flags)[1]
    except ParseError as e:
        code, at = e.code, e.position
    return {"code": code, "number": CODES[code], "message": MESSAGES[code], "offset": byte_offset(text, at), "line": text.count("\n", 0, at) + 1, "column": at - (text.rfind("\n", 0, at) + 1) + 1}


def split(text: str, flags: ParseFlags = ParseFlags(stop_when_done=True)):
    """Yields (start, end, value or None, error) of each of the documents laid end to end; ends at the first error."""
    return _split(text, flags, _FAST.scan_once)


def spans(text: str, flags: ParseFlags = ParseFlags(stop_when_done=True)):
    """As ``split``, in byte offsets besides: yields (start, end, byte start, byte end, error), without values."""
    ascii_, at, size = text.isascii(), 0, 0
    for start, end, _, error in _split(text, flags, _PLACES.scan_once):
        if ascii_:
            yield start, end, start, end, error
            continue
        begun = size + byte_offset(text[at:start], start - at)
        at, size = end, begun + byte_offset(text[start:end], end - start)
        yield start, end, begun, size, error


def _split(text: str, flags: ParseFlags, scan):
    """The interpreter's scanner takes one document after the other; the parser, whatever that cannot judge."""
    at, plain = 0, flags == _ONE_BY_ONE
    while True:
        if plain:
            start = _SPACE.match(text, at).end()
            try:
                value, end = scan(text, start)
                # a number before one of these may be one that is cut off
                if text[end : end + 1] not in _NUMBER_GOES_ON and not _UNSURE.search(text, start, end):
                    yield start, end, value, None
                    at = end
                    continue
            except (StopIteration, ValueError, _Unsure, RecursionError):
                pass
        p = _Parser(text, flags)
        p.at = at
        try:
            if not p.space():
                return
            start = p.at
            value = p.document()
        except ParseError as e:
            yield at, e.position, None, e
            return
        at = p.at
        yield start, at, value, None


def tokens(text: str, flags: ParseFlags = DEFAULT):
    """Events in order: (kind, name or None, value or None, depth); a ParseError ends them."""
    yield from events(parse(text, flags)[0])


def events(root):
    """``tokens`` of a parsed value."""
    work = [(root, None)]
    depth = 0
    while work:
        item = work.pop()
        if item[1] is _END:
            depth -= 1
            yield item[0], None, None, depth
            continue
        value, name = item
        if name is not None:
            yield "key", name, name, depth
        if isinstance(value, Obj):
            yield "start_object", None, None, depth
            work.append(("end_object", _END))
            work += [(v, k) for k, v in reversed(value)]
            depth += 1
        elif isinstance(value, list):
            yield "start_array", None, None, depth
            work.append(("end_array", _END))
            work += [(v, None) for v in reversed(value)]
            depth += 1
        else:
            yield kind(value), None, value, depth


_END = object()


def event_columns(roots):
    """The events of many documents as columns: (ends, kinds, values, depths); those of document k end at ``ends[k]``."""
    kinds: list[str] = []
    values: list = []
    depths: list[int] = []
    ends: list[int] = []
    put_kind, put_value, put_depth = kinds.append, values.append, depths.append

    def put(what: str, value, depth: int) -> None:
        put_kind(what)
        put_value(value)
        put_depth(depth)

    def walk(v, depth: int) -> None:
        t = type(v)
        if t is Obj:
            put("start_object", None, depth)
            for k, x in v:
                put_kind("key")
                put_value(k)
                put_depth(depth + 1)
                t = type(x)
                if t is int and -2147483648 <= x < 2147483648:
                    put_kind("int32")
                    put_value(x)
                    put_depth(depth + 1)
                elif t is str:
                    put_kind("string")
                    put_value(x)
                    put_depth(depth + 1)
                else:
                    walk(x, depth + 1)
            put("end_object", None, depth)
        elif t is list:
            put("start_array", None, depth)
            for x in v:
                walk(x, depth + 1)
            put("end_array", None, depth)
        else:
            put(kind(v), v, depth)

    for root in roots:
        begun = len(kinds)
        try:
            if root is not MISSING:
                walk(root, 0)
        except RecursionError:
            del kinds[begun:], values[begun:], depths[begun:]
            for what, _, value, depth in events(root):
                put(what, value, depth)
        ends.append(len(kinds))
    return ends, kinds, values, depths


class MISSING:
    """In the place of a value that there is none of; a class, since workers get those by name."""


def kind(value) -> str:
    """null, bool, int32, int64, uint64, double, raw_number, string, object or array."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int32" if -(1 << 31) <= value < 1 << 31 else "int64" if value < 1 << 63 else "uint64"
    if isinstance(value, float):
        return "double"
    if isinstance(value, Raw):
        return "raw_number"
    return "string" if isinstance(value, str) else "object" if isinstance(value, Obj) else "array"

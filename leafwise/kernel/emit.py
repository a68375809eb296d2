"""Values to JSON text: compact, pretty, with the shortest digits of a double in a fixed layout."""

from __future__ import annotations

import math
import re

from leafwise.kernel.lexer import Obj, Raw
from leafwise.options import WriteFlags

DEFAULT = WriteFlags()
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile(r'["\\\x00-\x1f]')
_NOT_ASCII = re.compile(r'["\\\x00-\x1f]|[^\x00-\x7f]')


class WriteError(ValueError):
    pass


def _escaped(m: re.Match) -> str:
    c = m[0]
    if c in _SHORT:
        return _SHORT[c]
    units = c.encode("utf-16-be", "surrogatepass")
    return "".join(f"\\u{units[k]:02X}{units[k + 1]:02X}" for k in range(0, len(units), 2))


def quote(text: str, ascii_only: bool = False) -> str:
    return f'"{(_NOT_ASCII if ascii_only else _SPECIAL).sub(_escaped, text)}"'


def format_double(value: float, max_decimals: int | None = None) -> str:
    """Shortest digits that read back as ``value``: plain up to 21 integer digits and 6 leading zeros, always with a
    fraction, else with an exponent. ``max_decimals`` cuts the fraction of plain forms."""
    if value == 0:
        return "-0.0" if math.copysign(1, value) < 0 else "0.0"
    sign, text = ("-", repr(-value)) if value < 0 else ("", repr(value))
    mantissa, _, exponent = text.partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        whole, fraction = digits[:point].ljust(point, "0"), digits[point:]
    elif -6 < point <= 0:
        whole, fraction = "0", "0" * -point + digits
    elif max_decimals is not None and point < -max_decimals:
        return sign + "0.0"
    else:
        shown = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{sign}{shown}e{point - 1}"
    if max_decimals is not None and len(fraction) > max_decimals:
        fraction = fraction[:max_decimals].rstrip("0")
    return f"{sign}{whole}.{fraction or '0'}"


def scalar(value, flags: WriteFlags = DEFAULT) -> str:
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, Raw):
        return str(value)
    if isinstance(value, str):
        return quote(value, flags.ascii_only)
    if isinstance(value, int):
        return str(value)
    if math.isfinite(value):
        return format_double(value, flags.max_decimals)
    if flags.nan_and_inf == "null":
        return "null"
    if flags.nan_and_inf == "literal":
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    raise WriteError("NaN and infinities have no JSON form")


#: Levels that the recursive writer goes down; deeper values take the writer with a stack of its own.
SHALLOW = 100


class _Deep(Exception):
    pass


#: Names as they are written, with the colon; emptied when there are very many.
_NAMES: dict[str, str] = {}


def _name(name: str) -> str:
    if len(_NAMES) > 10_000:
        _NAMES.clear()
    made = _NAMES[name] = quote(name) + ":"
    return made


def _compact(value, flags: WriteFlags, room: int) -> str:
    kind = type(value)
    if kind is not Obj and kind is not list:
        return scalar(value, flags)
    if not room:
        raise _Deep
    room -= 1
    out: list[str] = []
    put, ascii_only = out.append, flags.ascii_only
    for v in value:
        if kind is Obj:
            k, v = v
            head = quote(k, True) + ":" if ascii_only else _NAMES.get(k) or _name(k)
        else:
            head = ""
        t = type(v)
        if t is int:
            put(f"{head}{v}")
        elif t is str:
            put(f'{head}"{v}"' if v.isalnum() and not ascii_only else head + quote(v, ascii_only))
        elif t is Obj or t is list:
            put(head + _compact(v, flags, room))
        else:
            put(head + scalar(v, flags))
    return f"{{{','.join(out)}}}" if kind is Obj else f"[{','.join(out)}]"


def _indented(value, line: str, indent: str, single: bool, room: int) -> str:
    """``line``: what begins a line of the container that ``value`` is in."""
    kind = type(value)
    if kind is not Obj and kind is not list:
        return scalar(value)
    if not value:
        return "{}" if kind is Obj else "[]"
    if not room:
        raise _Deep
    if single and kind is list:
        # within, there are no line ends; an object there still parts its names by a colon and a space
        return _one_line(value, room)
    room -= 1
    below = line + indent
    out: list[str] = []
    put = out.append
    for v in value:
        if kind is Obj:
            k, v = v
            head = f"{_NAMES.get(k) or _name(k)} "
        else:
            head = ""
        t = type(v)
        if t is int:
            put(f"{head}{v}")
        elif t is str:
            put(f'{head}"{v}"' if v.isalnum() else head + quote(v))
        else:
            put(head + _indented(v, below, indent, single, room))
    body = f",{below}".join(out)
    return f"{{{below}{body}{line}}}" if kind is Obj else f"[{below}{body}{line}]"


def _one_line(value, room: int) -> str:
    kind = type(value)
    if kind is not Obj and kind is not list:
        return scalar(value)
    if not room:
        raise _Deep
    if kind is Obj:
        return "{" + ",".join([f"{_NAMES.get(k) or _name(k)} {_one_line(v, room - 1)}" for k, v in value]) + "}"
    return "[" + ", ".join([_one_line(v, room - 1) for v in value]) + "]"


def dumps(value, indent: str | None = None, single_line_arrays: bool = False, flags: WriteFlags = DEFAULT) -> str:
    """Compact text, or with ``indent`` (what a level adds) on lines of its own. Any depth can be written."""
    try:
        if indent is None:
            return _compact(value, flags, SHALLOW)
        if flags == DEFAULT:
            return _indented(value, "\n", indent, single_line_arrays, SHALLOW)
    except _Deep:
        pass
    out: list[str] = []
    put = out.append
    work: list = [value]
    depth = 0
    inline = 0  # levels of single-line arrays around
    while work:
        item = work.pop()
        if type(item) is tuple:
            op, text = item
            if op == "text":
                put(text)
            elif op == "line":
                if indent is not None and not inline:
                    put("\n" + indent * depth)
            elif op == "close":
                depth -= 1
                if indent is not None and not inline:
                    put("\n" + indent * depth)
                put(text)
            else:
                inline -= 1
                put("]")
            continue
        if not isinstance(item, list):
            put(scalar(item, flags))
            continue
        is_object = isinstance(item, Obj)
        if not item:
            put("{}" if is_object else "[]")
            continue
        one_line = single_line_arrays and indent is not None and not is_object
        if one_line:
            inline += 1
            put("[")
            steps: list = []
            for i, v in enumerate(item):
                if i:
                    steps.append(("text", ", "))
                steps.append(v)
            steps.append(("inline", None))
        else:
            put("{" if is_object else "[")
            depth += 1
            steps = []
            for i, v in enumerate(item):
                if i:
                    steps.append(("text", ","))
                steps.append(("line", None))
                if is_object:
                    steps.append(("text", quote(v[0], flags.ascii_only) + (": " if indent is not None else ":")))
                    v = v[1]
                steps.append(v)
            steps.append(("close", "}" if is_object else "]"))
        work += reversed(steps)
    return "".join(out)


def jsonx(value) -> str:
    """The JSONx (XML) form of a value."""
    from xml.sax.saxutils import escape

    space = ' xsi:schemaLocation="http://www.datapower.com/schemas/json jsonx.xsd" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:json="http://www.ibm.com/xmlns/prod/2009/jsonx"'
    out = ['<?xml version="1.0" encoding="UTF-8"?>']
    work: list = [(value, None, space)]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        v, name, extra = item
        label = extra + ("" if name is None else f' name="{escape(name, {chr(34): "&quot;"})}"')
        if isinstance(v, list):
            tag = "object" if isinstance(v, Obj) else "array"
            out.append(f"<json:{tag}{label}>")
            work.append(f"</json:{tag}>")
            work += [(x[1], x[0], "") if tag == "object" else (x, None, "") for x in reversed(v)]
        elif v is None:
            out.append(f"<json:null{label}/>")
        else:
            tag = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) and not isinstance(v, Raw) else "number"
            text = escape(v, {'"': "&quot;"}) if isinstance(v, str) else scalar(v)
            out.append(f"<json:{tag}{label}>{text}</json:{tag}>")
    return "".join(out)

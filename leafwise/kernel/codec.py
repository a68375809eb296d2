"""Functions made for one message type: encode, decode and read from JSON without looking at descriptors.

They take what is usual (fields in order, kinds that fit) and raise ``Unusual`` for the rest, which the general code of
``wire`` and ``transcode`` then judges from the start.
"""

from __future__ import annotations

import struct
from binascii import a2b_base64

TOO_BIG = 3.4028234663852886e38


class Unusual(Exception):
    pass


def _small() -> list[bytes]:
    return [bytes([v]) if v < 128 else bytes([v & 127 | 128, v >> 7]) for v in range(1 << 14)]


VARINTS = _small()


def varint(v: int) -> bytes:
    if 0 <= v < 16384:
        return VARINTS[v]
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def more(data: bytes, at: int) -> tuple[int, int]:
    """A varint of more than a byte."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise Unusual


class Made:
    """``decode`` of bytes to a message, ``encode`` of a message, ``read`` of a parsed JSON object to a message; each None if
    the type, or one that it leads to, is out of the usual."""

    def __init__(self, desc, pool):
        self.decode = self.encode = self.read = None
        reached, work = {}, [desc.full_name]
        while work:
            name = work.pop()
            if name not in reached:
                reached[name] = message = pool.messages.get(name)
                if message is None or message.is_any or any(f.kind == "group" or not 0 < f.number < 16 for f in message.by_number.values()) or len(message.by_name) != len(message.by_number):
                    return
                if any(f.kind == "enum" and f.type_name not in pool.enums for f in message.by_number.values()):
                    return
                work += [f.type_name for f in message.by_number.values() if f.kind == "message"]
        names = {name: f"m{i}" for i, name in enumerate(reached)}
        space = {"Unusual": Unusual, "varint": varint, "more": more, "VARINTS": VARINTS, "a2b_base64": a2b_base64, "TOO_BIG": TOO_BIG, "EMPTY": (0, False, "", b"", 0.0)}
        from leafwise.kernel.wire import Msg

        space |= {"Msg": Msg, "pool": pool}
        for kind in "dfQqIi":
            space[f"pack_{kind}"], space[f"take_{kind}"] = struct.Struct("<" + kind).pack, struct.Struct("<" + kind).unpack_from
        source = []
        for name, message in reached.items():
            space[f"desc_{names[name]}"] = message
            source += [*_decoder(message, names), *_encoder(message, names), *_reader(message, names, pool, space)]
        exec(compile("\n".join(source), f"<{desc.full_name}>", "exec"), space)  # noqa: S102  names are numbered, values are bound
        one = names[desc.full_name]
        self.decode, self.encode, self.read = space[f"decode_{one}"], space[f"encode_{one}"], space[f"read_{one}"]


FIXED = {"double": (1, "d", 8), "float": (5, "f", 4), "fixed64": (1, "Q", 8), "sfixed64": (1, "q", 8), "fixed32": (5, "I", 4), "sfixed32": (5, "i", 4)}
LENGTH = ("string", "bytes", "message")
VALUE = {"bool": "x != 0", "sint32": "(x >> 1) ^ -(x & 1)", "sint64": "(x >> 1) ^ -(x & 1)", "uint32": "x & 0xFFFFFFFF", "uint64": "x"}


def _wire(f) -> int:
    return FIXED[f.kind][0] if f.kind in FIXED else 2 if f.kind in LENGTH else 0


def _decoder(message, names) -> list[str]:
    me = names[message.full_name]
    out = [f"def decode_{me}(data, at, end):", f"    m = Msg(desc_{me}, pool)", "    values = m.values", "    tag = data[at] if at < end else 0"]
    for number in message.numbers:
        f = message.by_number[number]
        tag = number << 3 | _wire(f)
        out.append(f"    {'while' if f.repeated else 'if'} tag == {tag}:")
        body = ["at += 1"]
        if f.kind in FIXED:
            _, letter, size = FIXED[f.kind]
            body += [f"v = take_{letter}(data, at)[0]", f"at += {size}"]
        else:
            body += ["x = data[at]", "at += 1", "if x > 127:", "    x, at = more(data, at - 1)"]
            if f.kind in LENGTH:
                body += ["x += at", "if x > end:", "    raise Unusual"]
                body.append({"string": "v = data[at:x].decode('utf-8', 'surrogateescape')", "bytes": "v = data[at:x]", "message": f"v = decode_{names.get(f.type_name)}(data, at, x)"}[f.kind])
                body.append("at = x")
            elif f.kind in ("int32", "enum"):
                body += ["v = x & 0xFFFFFFFF", "if v > 2147483647:", "    v -= 4294967296"]
            elif f.kind == "int64":
                body += ["v = x if x < 9223372036854775808 else x - 18446744073709551616"]
            else:
                body.append(f"v = {VALUE[f.kind]}")
        body += ["if at > end:", "    raise Unusual"]
        if f.repeated:
            body += [f"if {f.name!r} in values:", f"    values[{f.name!r}].append(v)", "else:", f"    values[{f.name!r}] = [v]"]
        else:
            body.append(f"values[{f.name!r}] = v")
        body.append("tag = data[at] if at < end else 0")
        out += ["        " + line for line in body]
    return [*out, "    if at != end:", "        raise Unusual", "    return m"]


def _encoder(message, names) -> list[str]:
    me = names[message.full_name]
    out = [f"def encode_{me}(m):", "    values, out = m.values, m.unknown", "    parts = []", "    put = parts.append"]
    for number in message.numbers:
        f = message.by_number[number]
        packed = f.packed and f.repeated and f.kind not in LENGTH
        tag = bytes([number << 3 | (2 if packed else _wire(f))])
        if f.kind in FIXED:
            body = f"pack_{FIXED[f.kind][1]}(v)"
        elif f.kind in LENGTH:
            body = None
        elif f.kind in ("sint32", "sint64"):
            body = "varint((v << 1) ^ (v >> 63))"
        else:
            body = "varint(int(v))" if f.kind == "bool" else "(VARINTS[v] if 0 <= v < 16384 else varint(v))"
        get = {"string": "v.encode('utf-8', 'surrogateescape')", "bytes": "v", "message": f"encode_{names.get(f.type_name)}(v)"}.get(f.kind)
        lines = [f"b = {get}", f"put({tag!r} + (VARINTS[len(b)] if len(b) < 16384 else varint(len(b))) + b)"] if get else [f"put({tag!r} + {body})"]
        out.append(f"    v = values.get({f.name!r})")
        if packed:
            out += ["    if v:", f"        b = b''.join([{body} for v in v])", f"        put({tag!r} + varint(len(b)) + b)"]
        elif f.repeated:
            out += ["    if v:", "        for v in v:", *["            " + x for x in lines]]
        else:
            # a set field that is None, or an empty one of proto3, is left to the general code
            out += [f"    if v is not None{'' if not message.proto3 or f.kind == 'message' else ' and v not in EMPTY'}:", *["        " + x for x in lines], f"    elif v is None and {f.name!r} in values:", "        raise Unusual"]
    return [*out, "    return b''.join(parts) + out"]


RANGES = {"int32": (-(1 << 31), (1 << 31) - 1), "uint32": (0, (1 << 32) - 1), "int64": (-(1 << 63), (1 << 63) - 1), "uint64": (0, (1 << 64) - 1)}


def _reader(message, names, pool, space) -> list[str]:
    from leafwise.kernel.lexer import Obj
    from leafwise.kernel.transcode import declared_steps

    me = names[message.full_name]
    space["Obj"] = Obj
    out = [f"def read_{me}(value):", "    if type(value) is not Obj:", "        raise Unusual", "    members = dict(value)", "    if len(members) != len(value):", "        raise Unusual", f"    m = Msg(desc_{me}, pool)", "    values = m.values"]
    for s in declared_steps(message, pool):
        f, name = s.field, s.field.name
        out.append(f"    v = members.get({s.json_name!r})")
        if f.required:
            out += ["    if v is None:", "        raise Unusual"]
        out.append("    if v is not None:")
        if s.is_map:
            entry = names[f.type_name]
            out += ["        if type(v) is not Obj:", "            raise Unusual", "        rows = []", "        for k, v in v:", *["            " + x for x in _read_one(s.entry, names, pool, space)]]
            out += [f"            e = Msg(desc_{entry}, pool)", "            e.values['key'] = k", "            e.values['value'] = v", "            rows.append(e)", "        if rows:", f"            values[{name!r}] = rows"]
        elif f.repeated:
            out += ["        if type(v) is not list:", "            raise Unusual", "        rows = []", "        for v in v:", *["            " + x for x in _read_one(f, names, pool, space)], "            rows.append(v)", f"        values[{name!r}] = rows"]
        else:
            out += [*["        " + x for x in _read_one(f, names, pool, space)], f"        values[{name!r}] = v"]
    return [*out, "    return m"]


def _read_one(f, names, pool, space) -> list[str]:
    """Lines that turn ``v`` into the field's value."""
    refuse = "    raise Unusual"
    if f.cls in RANGES:
        low, high = RANGES[f.cls]
        lines = [f"if type(v) is not int or not {low} <= v <= {high}:", refuse]
        if f.cls in ("int64", "uint64"):  # as text too
            lines = ["if type(v) is str and len(v) < 19 and v.isascii() and v.isdigit():", "    v = int(v)", "el" + lines[0], refuse]
        return lines
    if f.cls in ("float", "double"):
        return ["if type(v) is not int and type(v) is not float:", refuse, "v = float(v)", *(["if not -TOO_BIG <= v <= TOO_BIG:", refuse] if f.cls == "float" else [])]
    if f.cls == "bool":
        return ["if type(v) is not bool:", refuse]
    if f.cls == "enum":
        space[f"enum_{len(space)}"] = pool.enums[f.type_name].values
        return ["if type(v) is not str:", refuse, f"v = enum_{len(space) - 1}.get(v)", "if v is None:", refuse]
    if f.kind == "message":
        return [f"v = read_{names[f.type_name]}(v)"]
    return ["if type(v) is not str:", refuse, *(["v = a2b_base64(v, strict_mode=True)"] if f.kind == "bytes" else [])]

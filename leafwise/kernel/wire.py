"""Protobuf wire format and descriptors, in plain Python.

A ``Pool`` holds messages and enums, declared as a plain dict or read from the bytes of a FileDescriptorSet. ``Msg`` is a
message: field values by name; what the descriptor does not know is kept and written back.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: kind: (wire type, struct format of fixed width kinds)
WIRE = {"double": (1, "<d"), "float": (5, "<f"), "fixed64": (1, "<Q"), "sfixed64": (1, "<q"), "fixed32": (5, "<I"), "sfixed32": (5, "<i")}
VARINT = frozenset(("int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool", "enum"))
#: Kinds by descriptor number from 1, and the C++ class of each.
KINDS = ("double", "float", "int64", "uint64", "int32", "fixed64", "fixed32", "bool", "string", "group", "message", "bytes", "uint32", "enum", "sfixed32", "sfixed64", "sint32", "sint64")
CLASSES = {"sint32": "int32", "sfixed32": "int32", "fixed32": "uint32", "sint64": "int64", "sfixed64": "int64", "fixed64": "uint64"}
LABELS = ("optional", "required", "repeated")
MASK = (1 << 64) - 1


class WireError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    number: int
    kind: str
    label: str = "optional"
    type_name: str = ""
    default: object = None
    packed: bool = False
    extension: bool = False
    owner: str = ""

    def __post_init__(self):
        """``cls``: int32, int64, uint32, uint64, float, double, bool, enum, string, bytes or message."""
        own = {"repeated": self.label == "repeated", "required": self.label == "required", "full_name": f"{self.owner}.{self.name}", "cls": CLASSES.get(self.kind, self.kind)}
        for k, v in own.items():
            object.__setattr__(self, k, v)


@dataclass
class Enum:
    full_name: str
    values: dict[str, int]

    def __post_init__(self):
        self.names = {n: k for k, n in reversed(self.values.items())}


@dataclass
class Message:
    full_name: str
    fields: list[Field]
    proto3: bool = False
    extensions: list[Field] = field(default_factory=list)

    def __post_init__(self):
        self.index()

    def index(self) -> None:
        self.by_number = {f.number: f for f in [*self.extensions, *self.fields]}
        self.by_name = {f.name: f for f in [*self.extensions, *self.fields]}
        self.numbers = sorted(self.by_number)
        self.is_any = [(f.name, f.cls) for f in self.fields] == [("type_url", "string"), ("value", "bytes")]

    @property
    def name(self) -> str:
        return self.full_name.rsplit(".", 1)[-1]


class Pool:
    def __init__(self):
        self.messages: dict[str, Message] = {}
        self.enums: dict[str, Enum] = {}
        self.plans: dict = {}
        self.made: dict = {}

    def __getstate__(self) -> dict:
        """What is made for a message type is made anew in each process."""
        return self.__dict__ | {"made": {}}

    def codec(self, desc: Message):
        """The functions made for a message type; made anew when the type has other fields."""
        held = self.made.get(desc.full_name)
        if held is None or held[0] is not desc.by_number:
            from leafwise.kernel.codec import Made

            held = self.made[desc.full_name] = desc.by_number, Made(desc, self)
        return held[1]

    @classmethod
    def declare(cls, spec: dict, proto3: bool = False) -> Pool:
        """``{"Name": {"field": (number, kind[, label[, default]])}, "EnumName": {"VALUE": 0}}``; a kind that is no
        scalar names a message or an enum; names in parentheses such as ``(Name)`` extend that message."""
        pool = cls()
        enums = {k for k, v in spec.items() if v and all(isinstance(x, int) for x in v.values())}
        for k in enums:
            pool.enums[k] = Enum(k, dict(spec[k]))

        def made(owner: str, name: str, entry: tuple, extension: bool = False) -> Field:
            number, kind, label, default = (*entry, *("optional", None)[len(entry) - 2 :])
            scalar = kind in KINDS
            return Field(name, number, kind if scalar else "enum" if kind in enums else "message", label, "" if scalar else kind, default, proto3 and label == "repeated" and scalar and kind not in ("string", "bytes"), extension, owner)

        for k, v in spec.items():
            if k not in enums and not k.startswith("("):
                pool.messages[k] = Message(k, [made(k, n, e) for n, e in v.items()], proto3)
        for k, v in spec.items():
            if k.startswith("("):
                target = pool.messages[k.strip("()")]
                target.extensions = sorted([*target.extensions, *(made(target.full_name, n, e, True) for n, e in v.items())], key=lambda f: f.number)
                target.index()
        return pool

    @classmethod
    def from_descriptor_set(cls, data: bytes) -> Pool:
        """From a serialised FileDescriptorSet, as protoc writes it."""
        pool = cls()
        extended: list[tuple[str, Field]] = []

        def made(owner: str, f: Msg, proto3: bool, extension: bool = False) -> Field:
            kind, label = KINDS[f["type"] - 1], LABELS[(1, 2, 3).index({1: 1, 2: 2, 3: 3}[f["label"]])]
            packed = f["options"]["packed"] if f["options"] and f["options"].has("packed") else proto3 and label == "repeated" and (kind in VARINT or kind in WIRE)
            return Field(f["name"], f["number"], kind, label, f["type_name"].lstrip("."), _default(kind, f["default_value"]) if f.has("default_value") else None, packed, extension, owner)

        def walk(prefix: str, m: Msg, proto3: bool) -> None:
            name = prefix + m["name"]
            pool.messages[name] = Message(name, [made(name, f, proto3) for f in m["field"]], proto3)
            for e in m["enum_type"]:
                pool.enums[f"{name}.{e['name']}"] = Enum(f"{name}.{e['name']}", {v["name"]: v["number"] for v in e["value"]})
            for x in m["extension"]:
                extended.append((x["extendee"].lstrip("."), made(name, x, proto3, True)))
            for n in m["nested_type"]:
                walk(name + ".", n, proto3)

        for f in decode(data, _BOOT.messages["FileDescriptorSet"], _BOOT)["file"]:
            prefix, proto3 = f["package"] + "." if f["package"] else "", f["syntax"] == "proto3"
            for m in f["message_type"]:
                walk(prefix, m, proto3)
            for e in f["enum_type"]:
                pool.enums[prefix + e["name"]] = Enum(prefix + e["name"], {v["name"]: v["number"] for v in e["value"]})
            for x in f["extension"]:
                extended.append((x["extendee"].lstrip("."), made(f["package"], x, proto3, True)))
        for target, x in extended:
            message = pool.messages[target]
            message.extensions = sorted([*message.extensions, x], key=lambda e: e.number)
            message.index()
        return pool

    def message(self, full_name: str) -> Message:
        try:
            return self.messages[full_name]
        except KeyError:
            raise WireError(f"no message type {full_name}") from None


def _default(kind: str, text: str):
    if kind == "bool":
        return text == "true"
    if kind in ("float", "double"):
        return float(text)
    return text if kind in ("string", "enum") else text.encode("latin-1") if kind == "bytes" else int(text)


class Msg:
    """A message; ``values`` has the fields that are set (repeated ones as lists)."""

    __slots__ = ("desc", "pool", "values", "unknown")

    def __init__(self, desc: Message, pool: Pool):
        self.desc, self.pool, self.values, self.unknown = desc, pool, {}, b""

    def has(self, name: str) -> bool:
        f = self.desc.by_name[name]
        if f.repeated:
            return bool(self.values.get(name))
        if name not in self.values:
            return False
        return not self.desc.proto3 or f.kind == "message" or self.values[name] not in (0, False, "", b"", 0.0)

    def __getitem__(self, name: str):
        if name in self.values:
            return self.values[name]
        return default_of(self.desc.by_name[name], self.pool)

    def new(self, f: Field) -> Msg:
        return Msg(self.pool.message(f.type_name), self.pool)


def default_of(f: Field, pool: Pool):
    if f.repeated:
        return []
    if f.kind == "message":
        return None
    if f.kind == "enum":
        values = pool.enums[f.type_name].values
        return values.get(f.default, f.default) if f.default is not None else next(iter(values.values()), 0)
    if f.default is not None:
        return f.default
    return {"bool": False, "string": "", "bytes": b"", "float": 0.0, "double": 0.0}.get(f.kind, 0)


def is_map(f: Field, pool: Pool) -> bool:
    """A repeated message of exactly a string ``key`` and a ``value``."""
    if not f.repeated or f.kind != "message":
        return False
    names = pool.message(f.type_name).fields
    return len(names) == 2 and names[0].name == "key" and names[0].kind == "string" and not names[0].repeated and names[1].name == "value"


def is_any(desc: Message) -> bool:
    """Exactly a string ``type_url`` and bytes ``value``."""
    return desc.is_any


def _varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("bad varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & MASK, at
        shift += 7


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def _from_varint(kind: str, raw: int):
    if kind == "bool":
        return raw != 0
    if kind in ("sint32", "sint64"):
        return (raw >> 1) ^ -(raw & 1)
    if kind in ("int32", "enum"):
        return _signed(raw, 32)
    return _signed(raw, 64) if kind == "int64" else raw & 0xFFFFFFFF if kind == "uint32" else raw


def decode(data: bytes, desc: Message, pool: Pool) -> Msg:
    data = bytes(data)
    if (usual := pool.codec(desc).decode) is not None:
        try:
            return usual(data, 0, len(data))
        except Exception:  # noqa: BLE001, S110  judged again from the start
            pass
    return _decode(data, desc, pool)


def _decode(data: bytes, desc: Message, pool: Pool) -> Msg:
    out, at = Msg(desc, pool), 0
    unknown = bytearray()
    while at < len(data):
        begun = at
        if (tag := data[at]) < 128:
            at += 1
        else:
            tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        f = desc.by_number.get(number)
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            end = at + (8 if wire == 1 else 4)
            raw, at = data[at:end], end
        elif wire == 2:
            if at < len(data) and (size := data[at]) < 128:
                at += 1
            else:
                size, at = _varint(data, at)
            raw, at = data[at : at + size], at + size
        else:
            raise WireError(f"wire type {wire} is not supported")
        if at > len(data):
            raise WireError("message is cut off")
        if f is None or not _take(out, f, wire, raw):
            unknown += data[begun:at]
    out.unknown = bytes(unknown)
    return out


def _take(out: Msg, f: Field, wire: int, raw) -> bool:
    """Puts a value into its field; false if the wire type is another."""
    if f.kind in VARINT and wire == 0:
        values = [_from_varint(f.kind, raw)]
    elif f.kind in WIRE and wire == WIRE[f.kind][0]:
        values = [struct.unpack(WIRE[f.kind][1], raw)[0]]
    elif wire == 2 and f.kind == "string":
        values = [raw.decode("utf-8", "surrogateescape")]
    elif wire == 2 and f.kind == "bytes":
        values = [raw]
    elif wire == 2 and f.kind == "message":
        made = decode(raw, out.pool.message(f.type_name), out.pool)
        if not f.repeated and f.name in out.values:
            _merge(out.values[f.name], made)
            return True
        values = [made]
    elif wire == 2 and f.repeated and f.kind in VARINT:
        values, at = [], 0
        while at < len(raw):
            v, at = _varint(raw, at)
            values.append(_from_varint(f.kind, v))
    elif wire == 2 and f.repeated and f.kind in WIRE:
        if len(raw) % struct.calcsize(WIRE[f.kind][1]):
            raise WireError("packed field is cut off")
        values = [v[0] for v in struct.iter_unpack(WIRE[f.kind][1], raw)]
    else:
        return False
    if f.repeated:
        out.values.setdefault(f.name, []).extend(values)
    else:
        out.values[f.name] = values[-1]
    return True


def _merge(a: Msg, b: Msg) -> None:
    for k, v in b.values.items():
        if isinstance(v, list):
            a.values.setdefault(k, []).extend(v)
        elif isinstance(v, Msg) and k in a.values:
            _merge(a.values[k], v)
        else:
            a.values[k] = v
    a.unknown += b.unknown


def _put_varint(out: bytearray, value: int) -> None:
    value &= MASK
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


def _put(out: bytearray, f: Field, value) -> None:
    """The value without its tag."""
    if f.kind in WIRE:
        out += struct.pack(WIRE[f.kind][1], value)
    elif f.kind in VARINT:
        if f.kind in ("sint32", "sint64"):
            value = (value << 1) ^ (value >> 63)
        _put_varint(out, int(value))
    else:
        data = encode(value) if f.kind == "message" else value.encode("utf-8", "surrogateescape") if f.kind == "string" else value
        _put_varint(out, len(data))
        out += data


def encode(message: Msg) -> bytes:
    """Fields by number, then what was unknown."""
    if (usual := message.pool.codec(message.desc).encode) is not None:
        try:
            return usual(message)
        except Exception:  # noqa: BLE001, S110  judged again from the start
            pass
    return _encode(message)


def _encode(message: Msg) -> bytes:
    out = bytearray()
    for number in message.desc.numbers:
        f = message.desc.by_number[number]
        if f.name not in message.values or not message.has(f.name):
            continue
        values = message.values[f.name] if f.repeated else [message.values[f.name]]
        if f.packed and f.repeated:
            body = bytearray()
            for v in values:
                _put(body, f, v)
            _put_varint(out, number << 3 | 2)
            _put_varint(out, len(body))
            out += body
            continue
        wire = 0 if f.kind in VARINT else WIRE[f.kind][0] if f.kind in WIRE else 2
        for v in values:
            _put_varint(out, number << 3 | wire)
            _put(out, f, v)
    return bytes(out) + message.unknown


_BOOT = Pool.declare(
    {
        "FileDescriptorSet": {"file": (1, "FileDescriptorProto", "repeated")},
        "FileDescriptorProto": {"name": (1, "string"), "package": (2, "string"), "message_type": (4, "DescriptorProto", "repeated"), "enum_type": (5, "EnumDescriptorProto", "repeated"), "extension": (7, "FieldDescriptorProto", "repeated"), "syntax": (12, "string")},
        "DescriptorProto": {"name": (1, "string"), "field": (2, "FieldDescriptorProto", "repeated"), "nested_type": (3, "DescriptorProto", "repeated"), "enum_type": (4, "EnumDescriptorProto", "repeated"), "extension": (6, "FieldDescriptorProto", "repeated")},
        "FieldDescriptorProto": {"name": (1, "string"), "extendee": (2, "string"), "number": (3, "int32"), "label": (4, "int32"), "type": (5, "int32"), "type_name": (6, "string"), "default_value": (7, "string"), "options": (8, "FieldOptions")},
        "FieldOptions": {"packed": (2, "bool")},
        "EnumDescriptorProto": {"name": (1, "string"), "value": (2, "EnumValueDescriptorProto", "repeated")},
        "EnumValueDescriptorProto": {"name": (1, "string"), "number": (2, "int32")},
    }
)

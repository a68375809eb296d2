"""Message descriptors as Spark types, so that decoded Protobuf columns take part in built-in plans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

from leafwise.kernel.wire import Field, Message, Msg, Pool, decode, is_any, is_map

SCALARS = {"int32": IntegerType(), "uint32": LongType(), "int64": LongType(), "uint64": DecimalType(20, 0), "float": FloatType(), "double": DoubleType(), "bool": BooleanType(), "string": StringType(), "bytes": BinaryType(), "enum": StringType()}


def struct_of(desc: Message, pool: Pool, depth: int = 8) -> StructType:
    """The struct of a message. Recursive types are cut at ``depth`` levels: what lies deeper stays bytes."""
    return StructType([StructField(f.name, _type(f, pool, depth)) for f in [*desc.extensions, *desc.fields]])


def _type(f: Field, pool: Pool, depth: int) -> DataType:
    if f.kind == "message" and depth <= 1:
        one: DataType = BinaryType()
    elif f.kind == "message":
        desc = pool.message(f.type_name)
        if is_map(f, pool):
            return MapType(StringType(), _type(desc.by_name["value"], pool, depth - 1))
        one = struct_of(desc, pool, depth - 1)
    else:
        one = SCALARS[f.cls]
    return ArrayType(one) if f.repeated else one


def row_of(message: Msg, depth: int = 8) -> dict:
    """The message as a row of ``struct_of``: unset singular fields are null."""
    pool = message.pool

    def one(f: Field, v):
        if f.kind == "message":
            from leafwise.kernel.wire import encode

            return encode(v) if depth <= 1 else row_of(v, depth - 1)
        return pool.enums[f.type_name].names.get(v, str(v)) if f.kind == "enum" else v

    out = {}
    for f in [*message.desc.extensions, *message.desc.fields]:
        if f.repeated and is_map(f, pool) and depth > 1:
            value = pool.message(f.type_name).by_name["value"]
            out[f.name] = [(e["key"], one(value, e["value"])) for e in message[f.name]]
        elif f.repeated:
            out[f.name] = [one(f, v) for v in message[f.name]]
        else:
            out[f.name] = one(f, message[f.name]) if f.name in message.values else None
    return out


def pb_decode(col, pool: Pool, name: str, depth: int = 8):
    """A Column of the decoded struct; null for bytes that are no such message."""
    from leafwise.functions.kernels import parts_kernel, structs
    from leafwise.kernel.wire import WireError

    desc = pool.message(name)

    def run(data: bytes):
        try:
            return row_of(decode(data, desc, pool), depth)
        except WireError:
            return None

    kind = struct_of(desc, pool, depth)
    arrow = to_arrow_type(kind)

    def part(messages: pa.Array) -> pa.Array:
        rows = [None if data is None else run(data) for data in messages.to_pylist()]
        return pa.array(rows, arrow) if None in rows or not rows else structs([[r[f.name] for r in rows] for f in kind], arrow)

    return parts_kernel(part, kind, col)


__all__ = ["is_any", "pb_decode", "row_of", "struct_of"]

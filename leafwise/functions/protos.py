"""Protobuf bytes as Columns. ``pool`` comes from ``Pool.declare`` or ``Pool.from_descriptor_set``; ``name`` is the message."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from leafwise.functions.documents import PRIMITIVE, parsed
from leafwise.functions.kernels import kernel, lists, parts_kernel, structs
from leafwise.kernel import flat, transcode
from leafwise.kernel.emit import WriteError, dumps
from leafwise.kernel.lexer import MISSING, Obj, ParseError, byte_offset, parse
from leafwise.kernel.transcode import TranscodeError
from leafwise.kernel.wire import Msg, Pool, WireError, decode, encode
from leafwise.options import JsonToPb, ParseFlags, PbToJson

STATUS = "code:string,message:string"


def _rows(run, returns: str, names: tuple[str, ...], *columns: Column | str) -> Column:
    """``kernel`` of a function that gives rows of scalars or None; they are put together by column."""
    arrow = to_arrow_type(_parse_datatype_string(returns))

    def part(*arrays: pa.Array) -> pa.Array:
        made = [None if r[0] is None else run(*r) for r in zip(*(a.to_pylist() for a in arrays), strict=True)]
        if None in made:
            return pa.array(made, arrow)
        return structs([[r[n] for r in made] for n in names], arrow)

    return parts_kernel(part, returns, *columns)


def pb_to_json(col: Column | str, pool: Pool, name: str, options: PbToJson = PbToJson()) -> Column:
    """(text, code, message) of each message."""
    desc = pool.message(name)

    def run(data: bytes):
        try:
            return {"text": dumps(transcode.to_json(decode(data, desc, pool), options), "    " if options.pretty else None), "code": "ok", "message": None}
        except (WireError, TranscodeError, WriteError) as e:
            return {"text": None, "code": "invalid_argument", "message": str(e)}

    return _rows(run, f"struct<text:string,{STATUS}>", ("text", "code", "message"), col)


def json_to_pb(col: Column | str, pool: Pool, name: str, options: JsonToPb = JsonToPb()) -> Column:
    """(msg, code, message, offset): the message's bytes; ``message`` also tells what optional fields were skipped."""
    desc = pool.message(name)

    def run(text: str):
        at = None
        try:
            value, end = parse(text, ParseFlags(stop_when_done=options.allow_remaining))
            at = byte_offset(text, end)
            made, skipped = transcode.from_json(value, desc, pool, options)
            return {"msg": encode(made), "code": "ok", "message": skipped or None, "offset": at}
        except ParseError as e:
            empty = e.code == "DocumentEmpty" and options.allow_remaining
            return {"msg": None, "code": "not_found" if empty else "invalid_argument", "message": "" if empty else f"Invalid json: {e}", "offset": byte_offset(text, e.position)}
        except TranscodeError as e:
            return {"msg": None, "code": "invalid_argument", "message": str(e), "offset": at}

    if options.allow_remaining:
        return kernel(run, f"struct<msg:binary,{STATUS},offset:bigint>", col)
    returns = f"struct<msg:binary,{STATUS},offset:bigint>"
    arrow = to_arrow_type(_parse_datatype_string(returns))

    def part(texts: pa.Array) -> pa.Array:
        rows = []
        for value, text, size in zip(parsed(texts), texts, pc.binary_length(texts).to_pylist(), strict=True):
            if value is MISSING:
                rows.append((None,) * 4 if size is None else tuple(run(text.as_py()).values()))
                continue
            try:
                made, skipped = transcode.from_json(value, desc, pool, options)
                rows.append((encode(made), "ok", skipped or None, size))
            except TranscodeError as e:
                rows.append((None, "invalid_argument", str(e), size))
        columns = [pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows, strict=True))] if rows else [[]] * 4
        made = structs(columns, arrow)
        return pc.if_else(texts.is_valid(), made, pa.scalar(None, arrow)) if texts.null_count else made

    return parts_kernel(part, returns, col)


def _entries(data: bytes, desc, pool, options):
    try:
        return list(transcode.leaves(decode(data, desc, pool), options))
    except (WireError, TranscodeError):
        return None


def pb_flatten(col: Column | str, pool: Pool, name: str, options: PbToJson = PbToJson()) -> Column:
    """array of (path, primitive)."""
    desc = pool.message(name)

    returns = f"array<struct<path:string,value:{PRIMITIVE}>>"
    arrow = to_arrow_type(_parse_datatype_string(returns))

    def part(messages: pa.Array) -> pa.Array:
        ends, good, paths, tags, values = [], [], [], [], []
        for data in messages.to_pylist():
            got = None if data is None else _entries(data, desc, pool, options)
            for p, t, v in got or ():
                paths.append(p)
                tags.append("int64" if t == "uint32" else t)
                values.append(v)
            ends.append(len(paths))
            good.append(got is not None)
        return lists(ends, good, [paths, structs(flat.primitive_columns(tags, values), arrow.value_type.field(1).type)], arrow)

    return parts_kernel(part, returns, col)


def pb_flatten_map(col: Column | str, pool: Pool, name: str, options: PbToJson = PbToJson()) -> Column:
    """map of path to text."""
    desc = pool.message(name)

    def run(data: bytes):
        got = _entries(data, desc, pool, options)
        return None if got is None else list({p: flat.text_of(t, v) for p, t, v in reversed(got)}.items())[::-1]

    return kernel(run, "map<string,string>", col)


def pb_flatten_json(col: Column | str, pool: Pool, name: str, options: PbToJson = PbToJson()) -> Column:
    """A flat JSON object of the paths."""
    desc = pool.message(name)

    def run(data: bytes):
        got = _entries(data, desc, pool, options)
        return None if got is None else dumps(Obj((p, v) for p, _, v in got), "    " if options.pretty else None)

    return kernel(run, "string", col)


def pb_set(col: Column | str, entries: Column, pool: Pool, name: str) -> Column:
    """(msg, code, message) after writing an array of (path, value as text) in order; ends at the first error, what was
    written before stays. A null message is an empty one."""
    desc = pool.message(name)

    def run(data: bytes, rows):
        message = decode(data, desc, pool) if data else Msg(desc, pool)
        for r in rows or []:
            try:
                transcode.set_flat(message, r["path"], "null" if r["value"] is None else None, r["value"])
            except flat.FlatError as e:
                return {"msg": encode(message), "code": "invalid_argument", "message": f"{r['path']}: {e}"}
        return {"msg": encode(message), "code": "ok", "message": None}

    source = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(bytearray()))
    return _rows(run, f"struct<msg:binary,{STATUS}>", ("msg", "code", "message"), source, entries)


def pb_set_typed(col: Column | str, entries: Column, pool: Pool, name: str) -> Column:
    """As ``pb_set`` for an array of (path, primitive), whose kinds must fit the fields."""
    desc = pool.message(name)

    def run(data: bytes, rows):
        message = decode(data, desc, pool) if data else Msg(desc, pool)
        for r in rows or []:
            v = r["value"]
            tag = v["vtype"] if v else "null"
            value = None if not v else v[{"string": "s", "bool": "b", "uint64": "u", "double": "d", "float": "d"}.get(tag, "i")]
            try:
                transcode.set_flat(message, r["path"], tag, int(value) if tag == "uint64" else value)
            except flat.FlatError as e:
                return {"msg": encode(message), "code": "invalid_argument", "message": f"{r['path']}: {e}"}
        return {"msg": encode(message), "code": "ok", "message": None}

    source = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(bytearray()))
    return kernel(run, f"struct<msg:binary,{STATUS}>", source, entries)


def kv_get(kv: Column | str, path: str) -> Column:
    """What a cached flat map has at a path."""
    return F.try_element_at(kv if isinstance(kv, Column) else F.col(kv), F.lit(path))

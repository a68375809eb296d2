"""JSON text columns: exact parsing, writing, editing, pointers and flat form.

A text that cannot be parsed gives null; ``parse_status`` tells why. Where a built-in does the same on well-formed text
(``sort_keys``, ``escape``), it is used and its limits are said.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from leafwise.functions.kernels import kernel, lists, ordinals, parts_kernel, structs
from leafwise.kernel import dom, flat
from leafwise.kernel.emit import WriteError, dumps, format_double as _format_double, jsonx as _jsonx, scalar
from leafwise.kernel.lexer import MISSING, UNSURE, Obj, ParseError, Raw, byte_offset, event_columns, kind, parse, parse_sure, spans, status
from leafwise.kernel.pointer import Pointer, apart, node_columns
from leafwise.options import FlattenOptions, ParseFlags, WriteFlags

STATUS = "struct<code:string,number:int,message:string,offset:bigint,line:bigint,column:bigint>"
PRIMITIVE = "struct<vtype:string,s:string,b:boolean,i:bigint,u:decimal(20,0),d:double,text:string>"
ENTRY = "struct<ord:int,path:string,vtype:string,value:string>"
PLAIN, LENIENT = ParseFlags(), ParseFlags(stop_when_done=True)


#: The last part of a column that was parsed, with its key and values: kernels of one batch share them.
_HELD: list = [None, None, None]


def parsed(texts: pa.Array, flags: ParseFlags = PLAIN) -> list:
    """Each text's value, ``MISSING`` for nulls and what cannot be parsed. Not to be changed: other kernels may get them too."""
    key = flags, texts.offset, len(texts), *(0 if b is None else b.address for b in texts.buffers())
    if _HELD[0] != key:
        _HELD[:] = None, None, None
        unsure = pc.match_substring_regex(texts, UNSURE).to_pylist() if flags == PLAIN else [True] * len(texts)
        _HELD[:] = key, texts, [_value(t, u, flags) for t, u in zip(texts.to_pylist(), unsure, strict=True)]
    return _HELD[2]


def _value(text: str | None, unsure: bool, flags: ParseFlags):
    try:
        return MISSING if text is None else parse(text, flags)[0] if unsure else parse_sure(text)
    except ParseError:
        return MISSING


def _edited(col: Column | str, edit, flags: ParseFlags = PLAIN, returns: str = "string", *more) -> Column:
    """``edit`` of each parsed text; null where parsing, or the edit, fails. It leaves the value as it is."""
    arrow = to_arrow_type(_parse_datatype_string(returns))

    def part(texts: pa.Array, *rest: pa.Array) -> pa.Array:
        out = []
        for v, *others in zip(parsed(texts, flags), *(r.to_pylist() for r in rest), strict=True):
            try:
                out.append(None if v is MISSING else edit(v, *others))
            except (ParseError, WriteError, flat.FlatError):
                out.append(None)
        return pa.array(out, arrow)

    return parts_kernel(part, returns, col, *more)


def _listed(col: Column | str, part, returns: str, flags: ParseFlags = PLAIN) -> Column:
    """Arrays of structs by ``part``, which makes of parsed values the lists' ends, whether each is good, and columns."""
    arrow = to_arrow_type(_parse_datatype_string(returns))
    return parts_kernel(lambda texts: lists(*part(parsed(texts, flags)), arrow), returns, col)


@lru_cache(1000)
def _constant(text: str):
    """The value of a text that is often given again. Not to be changed."""
    return parse(text)[0]


# Parsing


def parse_status(col: Column | str, flags: ParseFlags = PLAIN) -> Column:
    """struct of code, number, message, byte offset, line and column; code None with the end offset if all is well."""
    return kernel(lambda t: status(t, flags), STATUS, col)


def is_json(col: Column | str, flags: ParseFlags = PLAIN) -> Column:
    """Whether the text is one well-formed document."""
    return kernel(lambda t: status(t, flags)["number"] == 0, "boolean", col)


def bytes_status(col: Column | str, flags: ParseFlags = PLAIN) -> Column:
    """``parse_status`` of a text in UTF-8 bytes. With ``validate_encoding`` bytes that are no UTF-8 are an error where they
    stand; without it they are read as replacement characters."""

    def run(data: bytes):
        try:
            return status(data.decode("utf-8"), flags)
        except UnicodeDecodeError as e:
            if not flags.validate_encoding:
                return status(data.decode("utf-8", "replace"), flags)
            before = data[: e.start].decode("utf-8")
            line, column = before.count("\n") + 1, len(before) - before.rfind("\n")
            return {"code": "StringInvalidEncoding", "number": 12, "message": "Invalid encoding in string.", "offset": e.start, "line": line, "column": column}

    return kernel(run, STATUS, col)


def as_variant(col: Column | str) -> Column:
    """The text as a variant, by the built-in parser; null if that refuses it (as it does repeated names). It accepts
    what follows the document and lone surrogates: combine with ``is_json`` where that matters."""
    return F.try_parse_json(col)


def split_docs(col: Column | str, flags: ParseFlags = LENIENT) -> Column:
    """array of (doc_idx, text, start, end, error) of documents laid end to end; byte offsets; ends at an error."""

    def run(text: str):
        return [{"doc_idx": k, "text": None if e else text[a:b], "start": start, "end": end, "error": e.code if e else None} for k, (a, b, start, end, e) in enumerate(spans(text, flags))]

    return kernel(run, "array<struct<doc_idx:int,text:string,start:bigint,end:bigint,error:string>>", col)


def first_doc(col: Column | str, flags: ParseFlags = PLAIN) -> Column:
    """The first document and the byte offset behind it; what follows is not looked at."""

    def run(text: str):
        try:
            value, end = parse(text, replace(flags, stop_when_done=True))
        except ParseError as e:
            return {"text": None, "offset": byte_offset(text, e.position), "error": e.code}
        return {"text": dumps(value), "offset": byte_offset(text, end), "error": None}

    return kernel(run, "struct<text:string,offset:bigint,error:string>", col)


def tokens(col: Column | str, flags: ParseFlags = PLAIN) -> Column:
    """array of parse events (ord, kind, value as text, depth)."""

    def part(roots):
        ends, kinds, values, depths = event_columns(roots)
        shown = [v if type(v) is str else str(v) if k == "int32" else None if k in _SHAPES else scalar(v) for k, v in zip(kinds, values, strict=True)]
        return ends, [r is not MISSING for r in roots], [ordinals(ends), kinds, shown, depths]

    return _listed(col, part, "array<struct<ord:int,kind:string,value:string,depth:int>>", flags)


_SHAPES = frozenset(("start_object", "end_object", "start_array", "end_array"))

# Writing


def condense(col: Column | str, flags: ParseFlags = PLAIN, write: WriteFlags = WriteFlags()) -> Column:
    """Without white space; order, repeated names and number kinds stay."""
    return _edited(col, lambda v: dumps(v, flags=write), flags)


def pretty(col: Column | str, indent: int = 4, char: str = " ", single_line_arrays: bool = False, flags: ParseFlags = PLAIN) -> Column:
    return _edited(col, lambda v: dumps(v, char * indent, single_line_arrays), flags)


def sort_keys(col: Column | str, exact: bool = True) -> Column:
    """Members ordered by name. Not ``exact``: by the built-in variant, which also drops zeros behind the point."""
    if not exact:
        return F.to_json(F.try_parse_json(col))
    return _edited(col, lambda v: dumps(dom.rebuilt(v, order=lambda k: k.encode("utf-8", "surrogatepass"))))


def drop_key(col: Column | str, name: str) -> Column:
    """Without the members of that name, at any depth."""
    return _edited(col, lambda v: dumps(dom.rebuilt(v, keep=lambda k: k != name)))


def capitalize(col: Column | str, names: bool = True) -> Column:
    """Upper-case ASCII letters in strings, and in names with ``names``."""
    return _edited(col, lambda v: dumps(dom.capitalized(v, names)))


def jsonx(col: Column | str) -> Column:
    """The JSONx (XML) form."""
    return _edited(col, _jsonx)


def escape(col: Column | str) -> Column:
    """The string as a JSON string; built-in."""
    return F.regexp_replace(F.to_json(F.struct(F.col(col).alias("v") if isinstance(col, str) else col.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")


def format_double(col: Column | str, max_decimals: int | None = None) -> Column:
    """Shortest text of a double in the layout of JSON output."""
    return kernel(lambda d: _format_double(d, max_decimals) if d - d == 0 else None, "string", col)


def map_document(col: Column | str, function, returns: str = "string", flags: ParseFlags = PLAIN) -> Column:
    """An own function of each parsed document; one that returns a document returns its text (``emit.dumps``)."""
    return _edited(col, lambda v: function(dom.rebuilt(v)), flags, returns)


# Reading and editing values


def pointer_get(col: Column | str, pointer: str, flags: ParseFlags = PLAIN) -> Column:
    """(found, kind, value as JSON text, number of the first token that leads nowhere) by exact rules: the first of
    repeated names, array indexes without leading zeros."""
    p = Pointer.parse(pointer)

    def run(value):
        found, v, at = p.get(value)
        return {"found": found, "kind": kind(v) if found else None, "value": dumps(v) if found else None, "unresolved": at}

    return _edited(col, run, flags, "struct<found:boolean,kind:string,value:string,unresolved:int>")


def pointer_set(col: Column | str, pointer: str, value: Column) -> Column:
    """The text with JSON text ``value`` at the pointer; parents are made."""
    p = Pointer.parse(pointer)
    return _edited(col, lambda v, new: None if new is None else dumps(p.set(apart(v, p.tokens), _constant(new))[0]), PLAIN, "string", value)


def pointer_create(col: Column | str, pointer: str) -> Column:
    """The text with at least a null at the pointer."""
    p = Pointer.parse(pointer)
    return _edited(col, lambda v: dumps(p.create(apart(v, p.tokens))[0]))


def pointer_default(col: Column | str, pointer: str, default: str) -> Column:
    """(text, value): what is at the pointer, where ``default`` comes if nothing is."""
    p, made = Pointer.parse(pointer), parse(default)[0]

    def run(v):
        root, value = p.get_with_default(apart(v, p.tokens), made)
        return {"text": dumps(root), "value": dumps(value)}

    return _edited(col, run, PLAIN, "struct<text:string,value:string>")


def pointer_swap(col: Column | str, pointer: str, value: Column) -> Column:
    """(text, value): ``value`` put at the pointer, and what was there."""
    p = Pointer.parse(pointer)

    def run(v, new):
        if new is None:
            return None
        root, before, _ = p.set(apart(v, p.tokens), _constant(new))
        return {"text": dumps(root), "value": dumps(before)}

    return _edited(col, run, PLAIN, "struct<text:string,value:string>", value)


def pointer_erase(col: Column | str, pointer: str) -> Column:
    """(text, erased)."""
    p = Pointer.parse(pointer)

    def run(v):
        v = apart(v, p.tokens)
        done = p.erase(v)
        return {"text": dumps(v), "erased": done}

    return _edited(col, run, PLAIN, "struct<text:string,erased:boolean>")


def traverse(col: Column | str) -> Column:
    """array of (ord, pointer, kind) of every node in document order."""

    def part(roots):
        ends, pointers, values = node_columns(roots)
        return ends, [r is not MISSING for r in roots], [ordinals(ends), pointers, [kind(v) for v in values]]

    return _listed(col, part, "array<struct<ord:int,pointer:string,kind:string>>")


def json_equal(a: Column | str, b: Column | str) -> Column:
    """Deep equality: members in any order, 1 equals 1.0, objects that repeat a name equal nothing; null if not JSON."""

    def run(v, other):
        return None if other is None else dom.equal(v, _constant(other))

    return _edited(a, run, PLAIN, "boolean", b)


def value_kind(col: Column | str) -> Column:
    """null, bool, int32, int64, uint64, double, string, object or array."""
    return _edited(col, kind, PLAIN, "string")


def add_member(col: Column | str, name: str, value: Column) -> Column:
    """A member behind the others, even if the name is there; null if the text is no object."""
    return _edited(col, lambda v, new: dumps(Obj([*v, (name, _constant(new))])) if isinstance(v, Obj) and new is not None else None, PLAIN, "string", value)


def add_raw(col: Column | str, name: str, text: Column) -> Column:
    """A member whose value is ``text`` as it stands, unparsed; null if the document is no object."""
    return _edited(col, lambda v, new: dumps(Obj([*v, (name, Raw(new))])) if isinstance(v, Obj) and new is not None else None, PLAIN, "string", text)


def remove_member(col: Column | str, name: str, keep_order: bool = True) -> Column:
    """Without the first member of that name; without ``keep_order`` the last member takes its place."""

    def run(v):
        if not isinstance(v, Obj):
            return None
        v = Obj(v)
        at = v.index_of(name)
        if at >= 0 and keep_order:
            del v[at]
        elif at >= 0:
            last = v.pop()
            if at < len(v):
                v[at] = last
        return dumps(v)

    return _edited(col, run)


def array_edit(col: Column | str, erase: tuple[int, int] | None = None, push: str | None = None, pop: bool = False) -> Column:
    """An array without elements [from, to), with a JSON text pushed or the last popped; null if the text is no array."""
    made = None if push is None else parse(push)[0]

    def run(v):
        if not isinstance(v, list) or isinstance(v, Obj):
            return None
        v = list(v)
        if erase:
            del v[erase[0] : erase[1]]
        if push is not None:
            v.append(made)
        if pop and v:
            v.pop()
        return dumps(v)

    return _edited(col, run)


# Flat form


def _leaves(text: str, options: FlattenOptions):
    value, _ = parse(text, LENIENT if options.allow_remaining else PLAIN)
    return flat.leaves(value, options.exact)


def flatten(col: Column | str, options: FlattenOptions = FlattenOptions()) -> Column:
    """array of (ord, path, vtype, value as text) in document order; null for what is no object."""

    def part(roots):
        ends, good, paths, tags, values = flat.leaf_columns(roots, options.exact)
        return ends, good, [ordinals(ends), paths, tags, flat.shown(tags, values)]

    return _listed(col, part, f"array<{ENTRY}>", LENIENT if options.allow_remaining else PLAIN)


def flatten_status(col: Column | str, options: FlattenOptions = FlattenOptions()) -> Column:
    """(code, message, offset): ok, not_found (nothing left to read) or invalid_argument."""

    def run(text: str):
        try:
            value, end = parse(text, LENIENT if options.allow_remaining else PLAIN)
            for _ in flat.leaves(value, options.exact):
                pass
        except ParseError as e:
            empty = e.code == "DocumentEmpty" and options.allow_remaining
            return {"code": "not_found" if empty else "invalid_argument", "message": "" if empty else f"Invalid json: {e}", "offset": byte_offset(text, e.position)}
        except flat.FlatError as e:
            return {"code": "invalid_argument", "message": str(e), "offset": byte_offset(text, end)}
        return {"code": "ok", "message": None, "offset": byte_offset(text, end)}

    return kernel(run, "struct<code:string,message:string,offset:bigint>", col)


def flatten_typed(col: Column | str, options: FlattenOptions = FlattenOptions()) -> Column:
    """array of (path, primitive)."""

    returns = f"array<struct<path:string,value:{PRIMITIVE}>>"
    value = to_arrow_type(_parse_datatype_string(PRIMITIVE))

    def part(roots):
        ends, good, paths, tags, values = flat.leaf_columns(roots, options.exact)
        return ends, good, [paths, structs(flat.primitive_columns(tags, values), value)]

    return _listed(col, part, returns, LENIENT if options.allow_remaining else PLAIN)


def flatten_map(col: Column | str, options: FlattenOptions = FlattenOptions()) -> Column:
    """map of path to text, doubles with six decimals; of equal paths the first counts."""

    def run(text: str):
        out: dict[str, str] = {}
        try:
            for p, t, v in _leaves(text, options):
                out.setdefault(p, flat.text_of(t, v))
        except (ParseError, flat.FlatError):
            return None
        return list(out.items())

    return kernel(run, "map<string,string>", col)


def flatten_json(col: Column | str, indent: int | None = 4, options: FlattenOptions = FlattenOptions()) -> Column:
    """A flat JSON object of the paths; pretty unless ``indent`` is None."""

    def run(text: str):
        try:
            return dumps(Obj((p, v) for p, _, v in _leaves(text, options)), None if indent is None else " " * indent)
        except (ParseError, flat.FlatError):
            return None

    return kernel(run, "string", col)


def kv_text(entries: Column | str) -> Column:
    """key=value lines of a map, by key; built-in."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("\n"))), "")


def unflatten(entries: Column | str) -> Column:
    """JSON text of an array of (ord, path, vtype, value); null if paths contradict each other."""

    def part(rows: pa.Array) -> pa.Array:
        ends, out = rows.offsets.to_pylist(), []
        held = rows.values.slice(ends[0], ends[-1] - ends[0])
        columns = dict(zip([f.name for f in held.type], (c.to_pylist() for c in held.flatten()), strict=True))
        cells = list(zip(*(columns[n] for n in ("ord", "path", "vtype", "value")), strict=True))
        for a, b, valid in zip(ends, ends[1:], rows.is_valid().to_pylist()):
            try:
                out.append(dumps(flat.unflatten((r[1], flat.scalar_of(r[2], r[3])) for r in sorted(cells[a - ends[0] : b - ends[0]], key=itemgetter(0)))) if valid else None)
            except flat.FlatError:
                out.append(None)
        return pa.array(out, pa.string())

    return parts_kernel(part, "string", entries)


def parse_flat_key(col: Column | str) -> Column:
    """array of (key, index, has_array, is_index); built-in. Null for an empty path, an index at the root or one that is
    no integer."""
    path = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.split(path, r"\."), lambda p: p != "")
    is_index = lambda p: p.rlike(r"(?s)^\[.+\]$")
    good = (F.size(parts) > 0) & ~is_index(F.try_element_at(parts, F.lit(1))) & F.forall(parts, lambda p: ~is_index(p) | p.rlike(r"^\[[+-]?[0-9]+\]$"))
    after = lambda i: F.coalesce(is_index(F.get(parts, i + 1)), F.lit(False))
    segment = lambda p, i: F.struct(p.alias("key"), F.when(is_index(p), F.regexp_extract(p, r"^\[([+-]?[0-9]+)\]$", 1).try_cast("bigint")).alias("index"), (~is_index(p) & after(i)).alias("has_array"), is_index(p).alias("is_index"))
    return F.when(good, F.transform(parts, segment))


__all__ = [n for n, v in list(globals().items()) if callable(v) and not n.startswith("_") and getattr(v, "__module__", "") == __name__] + ["Raw"]

"""Functions and table functions for SQL text; ``register`` once for each session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.functions import udtf

from leafwise.kernel import dom, flat
from leafwise.kernel.emit import WriteError, dumps, jsonx
from leafwise.kernel.lexer import ParseError, kind, parse, split, status, tokens
from leafwise.kernel.pointer import Pointer, PointerError, traverse


def _each(function):
    """``function`` of parsed documents, null where it fails."""

    def run(text: str):
        try:
            return function(parse(text)[0])
        except (ParseError, WriteError):
            return None

    return run


def _pointer(text: str, pointer: str | None):
    try:
        found, value, _ = Pointer.parse(pointer or "").get(parse(text)[0])
    except (ParseError, PointerError):
        return None
    return dumps(value) if found else None


ONE = {
    "lw_condense": (_each(dumps), "string"),
    "lw_pretty": (_each(lambda v: dumps(v, "    ")), "string"),
    "lw_sort_keys": (_each(lambda v: dumps(dom.rebuilt(v, order=lambda k: k.encode("utf-8", "surrogatepass")))), "string"),
    "lw_capitalize": (_each(lambda v: dumps(dom.capitalized(v))), "string"),
    "lw_jsonx": (_each(jsonx), "string"),
    "lw_kind": (_each(kind), "string"),
    "lw_is_json": (lambda t: status(t)["number"] == 0, "boolean"),
    "lw_parse_error": (lambda t: None if status(t)["number"] == 0 else status(t)["code"], "string"),
}


@udtf(returnType="ord int, path string, vtype string, value string")
class Flatten:
    """Leaves of a document; no rows for what is no object."""

    def eval(self, doc: str):
        try:
            for i, (p, t, v) in enumerate(flat.leaves(parse(doc)[0]) if doc is not None else ()):
                yield i, p, t, flat.primitive(t, v)["text"]
        except (ParseError, flat.FlatError):
            return


@udtf(returnType="ord int, kind string, value string, depth int")
class Tokens:
    """Parse events of a document, up to an error."""

    def eval(self, doc: str):
        try:
            for i, (k, _, v, d) in enumerate(tokens(doc) if doc is not None else ()):
                yield i, k, v if isinstance(v, str) or v is None else dumps(v), d
        except ParseError:
            return


@udtf(returnType="doc_idx int, doc string, error string")
class SplitDocs:
    """Documents laid end to end."""

    def eval(self, doc: str):
        for i, (a, b, _, e) in enumerate(split(doc) if doc is not None else ()):
            yield i, None if e else doc[a:b], e.code if e else None


@udtf(returnType="ord int, pointer string, kind string")
class Traverse:
    """Every node with its pointer."""

    def eval(self, doc: str):
        try:
            for i, (p, v) in enumerate(traverse(parse(doc)[0]) if doc is not None else ()):
                yield i, str(p), kind(v)
        except ParseError:
            return


def register(spark: SparkSession) -> None:
    """lw_condense, lw_pretty, lw_sort_keys, lw_capitalize, lw_jsonx, lw_kind, lw_is_json, lw_parse_error, lw_pointer;
    lw_flatten, lw_tokens, lw_split_docs and lw_traverse as table functions."""
    arrow = {"string": pa.string(), "boolean": pa.bool_()}
    for name, (function, returns) in ONE.items():

        def batch(a: pa.Array, function=function, returns=returns) -> pa.Array:
            return pa.array([None if t is None else function(t) for t in a.to_pylist()], arrow[returns])

        spark.udf.register(name, F.arrow_udf(_one(batch), returns))

    def pointer(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _pointer(t, p) for t, p in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    spark.udf.register("lw_pointer", F.arrow_udf(pointer, "string"))
    for name, table in (("lw_flatten", Flatten), ("lw_tokens", Tokens), ("lw_split_docs", SplitDocs), ("lw_traverse", Traverse)):
        spark.udtf.register(name, table)


def _one(batch):
    def run(a: pa.Array) -> pa.Array:
        return batch(a)

    return run

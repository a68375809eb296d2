"""Flat form by built-ins: a projection where the schema is known, a fold over its levels where it is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StructType

ENTRIES = "array<struct<path:string,value:string>>"


def entries(value: Column, kind: DataType, path: Column | None = None) -> Column:
    """array of (path, text) of the scalars of a typed value; nulls and empty containers give nothing."""
    below = lambda k: k if path is None else F.concat(path, F.lit("."), k)
    none = F.array().cast(ENTRIES)
    if isinstance(kind, StructType):
        parts = [entries(value.getField(f.name), f.dataType, below(F.lit(f.name))) for f in kind.fields]
        return F.concat(*parts) if parts else none
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x, i: entries(x, kind.elementType, below(F.concat(F.lit("["), i.cast("string"), F.lit("]")))))
        return F.coalesce(F.flatten(each), none)
    if isinstance(kind, MapType):
        each = F.transform(F.map_entries(value), lambda e: entries(e["value"], kind.valueType, below(e["key"].cast("string"))))
        return F.coalesce(F.flatten(each), none)
    text = value.cast("string")
    if isinstance(kind, BooleanType):
        text = F.when(value, "true").otherwise("false")
    return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), text.alias("value")))).otherwise(none)


def flatten_static(df: DataFrame, col: str, schema: StructType, keep: list[str]) -> DataFrame:
    """(keep, path, value) rows of JSON text of a known schema; what the schema does not name is skipped."""
    parsed = df.select(*keep, F.from_json(col, schema).alias("v"))
    return parsed.select(*keep, F.explode(entries(F.col("v"), schema)).alias("e")).select(*keep, "e.path", "e.value")


#: ``open``: a container that is still to be opened, or a null, which has nothing in it.
NODES = "array<struct<path:string,v:variant,open:boolean>>"


def flatten_recursive(df: DataFrame, col: str, keep: list[str], levels: int = 100) -> DataFrame:
    """(keep, path, value) rows of any JSON objects by a fold of built-ins: each step opens the containers of one level.
    Documents nested deeper than ``levels`` fail the query. No shuffle, and each document is parsed once."""
    none = F.array().cast(NODES)
    below = lambda path, k: F.concat(path, F.when(path == "", "").otherwise("."), k)

    def opened(x: Column) -> Column:
        """What is in a container; a scalar stays. Nulls go."""
        path, v = x["path"], x["v"]
        members = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: _node(below(path, e["key"]), e["value"]))
        elements = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e, i: _node(below(path, F.concat(F.lit("["), i.cast("string"), F.lit("]"))), e))
        return F.when(x["open"], F.coalesce(members, elements, none)).otherwise(F.array(x))

    step = lambda held, _: F.when(F.forall(held, lambda x: ~x["open"]), held).otherwise(F.flatten(F.transform(held, opened)))
    # no document has more levels than opening brackets
    brackets = F.octet_length(col) - F.octet_length(F.translate(F.col(col), "{[", ""))
    rounds = F.sequence(F.lit(0), F.least(brackets, F.lit(levels)))
    root = F.try_parse_json(col)
    nodes = F.transform(F.array(root), lambda v: F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.aggregate(rounds, F.array(F.struct(F.lit("").alias("path"), v.alias("v"), F.lit(True).alias("open"))).cast(NODES), step)))
    rows = df.select(*keep, F.explode(F.get(nodes, F.lit(0))).alias("e"))
    too_deep = F.raise_error(F.lit(f"a document is nested deeper than {levels} levels")).cast("string")
    text = F.when(F.col("e.open"), too_deep).otherwise(F.col("e.v").cast("string"))
    return rows.select(*keep, "e.path", text.alias("value"))


def _node(path: Column, v: Column) -> Column:
    again = F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull() | F.is_variant_null(v)
    return F.struct(path.alias("path"), v.alias("v"), again.alias("open"))


def closed_schema(df: DataFrame, col: str) -> StructType | None:
    """The schema that all documents share, if it is closed; None if some part differs in type between documents."""
    from pyspark.sql.types import _parse_datatype_string

    text = df.select(F.schema_of_variant_agg(F.try_parse_json(col))).first()[0]
    if text is None or "VARIANT" in text or not text.startswith("OBJECT"):
        return None
    return _parse_datatype_string(text.replace("OBJECT<", "STRUCT<"))

"""Pointers that are known when the plan is built: one parse serves all of them, built-ins only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from leafwise.kernel.pointer import Pointer, index


def variant_paths(pointer: str) -> list[str]:
    """Variant paths that a pointer may mean: a token of digits names a member or an index."""
    ways = [[f'["{t}"]', *([f"[{t}]"] if index(t) is not None else [])] for t in Pointer.parse(pointer).tokens]
    return ["$" + "".join(w) for w in itertools.product(*ways)]


def get(v: Column, pointer: str, type_name: str = "variant") -> Column:
    """What is at a pointer of a variant; null if missing, or not of that type."""
    return F.coalesce(*[F.try_variant_get(v, p, type_name) for p in variant_paths(pointer)])


def has(v: Column, pointer: str) -> Column:
    """Whether something, be it a JSON null, is at the pointer."""
    return get(v, pointer).isNotNull()


def extract(df: DataFrame, col: str, wanted: dict[str, tuple[str, str]], default: dict[str, object] | None = None) -> DataFrame:
    """``df`` with a column for each name of (pointer, type). The text is parsed once for all of them; ``default`` is
    taken where nothing is found."""
    parsed = df.withColumn("__parsed", F.try_parse_json(col))
    columns = {}
    for name, (pointer, type_name) in wanted.items():
        found = get(F.col("__parsed"), pointer, type_name)
        columns[name] = found if name not in (default or {}) else F.coalesce(found, F.lit(default[name]).cast(type_name))
    return parsed.withColumns(columns).drop("__parsed")


def struct_for(wanted: dict[str, str]) -> StructType:
    """The smallest struct that holds pointers of names only: pointer to type."""
    root: dict = {}
    for pointer, type_name in wanted.items():
        node = root
        *way, last = Pointer.parse(pointer).tokens
        for t in way:
            node = node.setdefault(t, {})
        node[last] = _parse_datatype_string(type_name)

    def built(node) -> DataType:
        return node if isinstance(node, DataType) else StructType([StructField(k, built(v)) for k, v in node.items()])

    return built(root)


def extract_struct(df: DataFrame, col: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """As ``extract`` through one ``from_json`` of the smallest struct, which skips all else in the text."""
    parsed = df.withColumn("__parsed", F.from_json(col, struct_for({p: t for p, t in wanted.values()})))

    def at(pointer: str) -> Column:
        out = F.col("__parsed")
        for t in Pointer.parse(pointer).tokens:
            out = out.getField(t)
        return out

    return parsed.withColumns({name: at(p) for name, (p, _) in wanted.items()}).drop("__parsed")

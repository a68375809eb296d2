"""Type tests, getters and container functions on variants, all built-in.

The built-in parser keeps ``1.5`` as a decimal and loses zeros behind the point; a JSON null is not a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INT32, UINT32, INT64, UINT64 = ((-(1 << 31), (1 << 31) - 1), (0, (1 << 32) - 1), (-(1 << 63), (1 << 63) - 1), (0, (1 << 64) - 1))
FLOAT_MAX = 3.4028234663852886e38


def held(v: Column, use) -> Column:
    """``use(v)``, where ``v`` is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def kind(v: Column) -> Column:
    """null, boolean, integer, double, string, object or array; SQL null for a missing value."""

    def told(s: Column) -> Column:
        whole = (s == "BIGINT") | (s.rlike(r"^DECIMAL\([0-9]+,0\)$") & (F.abs(F.try_variant_get(v, "$", "double")) >= 9.2e18))
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
            .when(whole, "integer").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double")
        )

    return held(F.schema_of_variant(v), told)


def _between(v: Column, limits: tuple[int, int]) -> Column:
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in limits)
    n = F.try_variant_get(v, "$", "decimal(38,0)")
    return F.coalesce((kind(v) == "integer") & (n >= low) & (n <= high), F.lit(False))


def is_int32(v: Column) -> Column:
    return _between(v, INT32)


def is_uint32(v: Column) -> Column:
    return _between(v, UINT32)


def is_int64(v: Column) -> Column:
    return _between(v, INT64)


def is_uint64(v: Column) -> Column:
    return _between(v, UINT64)


def is_number(v: Column) -> Column:
    return kind(v).isin("integer", "double")


def is_null(v: Column) -> Column:
    return F.is_variant_null(v)


def is_true(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "boolean") & (kind(v) == "boolean"), F.lit(False))


def is_false(v: Column) -> Column:
    return F.coalesce(~F.try_variant_get(v, "$", "boolean") & (kind(v) == "boolean"), F.lit(False))


def is_lossless_double(v: Column) -> Column:
    """Whether an integer survives as a double."""
    n = F.try_variant_get(v, "$", "decimal(38,0)")
    return F.when(kind(v) == "double", F.lit(True)).otherwise(n.cast("double").cast("decimal(38,0)") == n)


def is_float(v: Column) -> Column:
    return (kind(v) == "double") & (F.abs(F.try_variant_get(v, "$", "double")) <= FLOAT_MAX)


def is_lossless_float(v: Column) -> Column:
    d = F.try_variant_get(v, "$", "double")
    return is_number(v) & (d.cast("float").cast("double") == d)


def get(v: Column, path: str, type_name: str = "variant") -> Column:
    """What is at a JSON path, in that type; null if missing or not so."""
    return F.try_variant_get(v, path, type_name)


def string_length(v: Column) -> Column:
    """Bytes of a string."""
    return F.octet_length(F.try_variant_get(v, "$", "string"))


def members(v: Column) -> Column:
    """map of names to values; null if it is no object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """array of values; null if it is no array."""
    return F.try_variant_get(v, "$", "array<variant>")


def has_member(v: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.map_keys(members(v)), name), F.lit(False))


def member_count(v: Column) -> Column:
    return held(members(v), lambda m: F.when(m.isNotNull(), F.size(F.map_keys(m))))


def array_length(v: Column) -> Column:
    return held(elements(v), lambda x: F.when(x.isNotNull(), F.size(x)))

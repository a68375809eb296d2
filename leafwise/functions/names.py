"""Field names: encoding of characters that Protobuf names cannot have, and camel case. All built-in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ASCII = [chr(i) for i in range(128)]


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def encode_name(col: Column | str) -> Column:
    """Every ASCII character but letters, digits and underscore, and a leading digit, becomes ``_Zddd_``; of other
    characters every byte."""
    code = lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.concat(F.lit("_Z"), F.lpad(F.conv(F.substring(F.hex(c), i * 2 - 1, F.lit(2)), 16, 10), 3, "0"), F.lit("_"))), "")
    plain = lambda c, i: c.rlike("^[A-Za-z_]$") | (c.rlike("^[0-9]$") & (i > 0))
    name = _column(col)
    return F.when(name == "", "").otherwise(F.array_join(F.transform(F.split(name, "(?s)(?<=.)(?=.)"), lambda c, i: F.when(plain(c, i), c).otherwise(code(c))), ""))


def decode_name(col: Column | str) -> Column:
    """``_Zddd_`` becomes the character of that code below 256."""
    name, pattern = _column(col), "_Z(25[0-5]|2[0-4][0-9]|[01][0-9]{2})_"
    codes = F.transform(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), lambda d: F.char(d.cast("int")))
    parts = F.split(name, pattern, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(codes, i), F.lit("")))), "")


def camel(col: Column | str) -> Column:
    """``_x`` becomes ``X``."""
    parts = F.split(_column(col), "_(?=[a-z])", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647))).otherwise(p)), "")

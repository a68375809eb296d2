"""Byte encodings and base64, built-in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Byte order marks in hex, the longer first, with the charset that each announces.
MARKS = (("0000FEFF", "UTF-32BE"), ("FFFE0000", "UTF-32LE"), ("EFBBBF", "UTF-8"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE"))
#: JSON begins with two ASCII characters: where the zeros are tells the encoding of unmarked bytes.
ZEROS = (("^000000..", "UTF-32BE"), ("^..000000", "UTF-32LE"), ("^00..(00|$)", "UTF-16BE"), ("^(?!00)..00", "UTF-16LE"))


def charset(data: Column) -> Column:
    """The Unicode encoding of bytes that hold JSON: by mark, else by the zeros among the first four bytes."""
    head, out = F.hex(F.substring(data, 1, 4)), None
    for mark, name in MARKS:
        test = head.startswith(mark)
        out = F.when(test, name) if out is None else out.when(test, name)
    for pattern, name in ZEROS:
        out = out.when(head.rlike(pattern), name)
    return out.otherwise("UTF-8")


def decode_text(data: Column, name: str | None = None) -> Column:
    """Bytes to text without the mark; the encoding is detected unless named. Null for bad UTF-8."""
    utf32 = lambda order: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(data) / 4).cast("int") - 1), lambda i: _point(F.hex(F.substring(data, i * 4 + 1, F.lit(4))), order)), "")
    found = F.lit(name) if name else charset(data)
    text = (
        F.when(found == "UTF-8", F.try_validate_utf8(data.cast("string")))
        .when(found == "UTF-16BE", F.decode(data, "UTF-16BE")).when(found == "UTF-16LE", F.decode(data, "UTF-16LE"))
        .when(F.octet_length(data) < 4, F.lit("")).when(found == "UTF-32BE", utf32("BE")).when(found == "UTF-32LE", utf32("LE"))
    )
    return F.regexp_replace(text, "^﻿", "")


def _point(code: Column, order: str) -> Column:
    """One character of four bytes in hex, by way of UTF-16."""
    big = code if order == "BE" else F.concat(*[F.substring(code, k, 2) for k in (7, 5, 3, 1)])
    n = F.conv(big, 16, 10).cast("bigint")
    rest = n - 0x10000
    pair = F.concat(F.lpad(F.hex(F.shiftright(rest, 10) + 0xD800), 4, "0"), F.lpad(F.hex(rest.bitwiseAND(0x3FF) + 0xDC00), 4, "0"))
    return F.decode(F.unhex(F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(pair)), "UTF-16BE")


def encode_text(text: Column, name: str = "UTF-8", mark: bool = False) -> Column:
    """Text to bytes, with the byte order mark on request."""
    marks = {n: m for m, n in MARKS}
    data = F.encode(text, name)
    return F.concat(F.unhex(F.lit(marks[name])), data) if mark else data


def to_base64(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "\\s", "")


def from_base64(text: Column) -> Column:
    """Bytes, or null for bad base64."""
    return F.try_to_binary(text, F.lit("base64"))

"""Options of the conversions, resolved when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ParseFlags:
    """What the parser accepts beyond RFC 8259, and how it reports numbers."""

    stop_when_done: bool = False
    comments: bool = False
    trailing_commas: bool = False
    nan_and_inf: bool = False
    escaped_apostrophe: bool = False
    numbers_as_strings: bool = False
    validate_encoding: bool = False


@dataclass(frozen=True)
class WriteFlags:
    """``nan_and_inf``: reject, literal or null. ``max_decimals`` cuts fractions without rounding."""

    nan_and_inf: str = "reject"
    ascii_only: bool = False
    max_decimals: int | None = None


@dataclass(frozen=True)
class PbToJson:
    """``standard`` follows the public JSON mapping: camel-case names, 64-bit integers and odd doubles as strings."""

    enum_by_name: bool = True
    pretty: bool = False
    maps: bool = True
    bytes_to_base64: bool = True
    empty_arrays: bool = False
    always_print: bool = False
    single_repeated_to_array: bool = False
    at_type: bool = False
    standard: bool = False


@dataclass(frozen=True)
class JsonToPb:
    base64_to_bytes: bool = True
    array_to_single_repeated: bool = False
    allow_remaining: bool = False
    camel_names: bool = False


@dataclass(frozen=True)
class FlattenOptions:
    """``exact`` keeps the quirks of the established flat form: doubles in float range are narrowed to float."""

    allow_remaining: bool = False
    exact: bool = False

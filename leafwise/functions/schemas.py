"""JSON Schema checks as Columns."""

from __future__ import annotations

from pyspark.sql import Column

from leafwise.functions.kernels import kernel
from leafwise.kernel.lexer import ParseError, parse
from leafwise.kernel.schema import Schema

REPORT = "struct<valid:boolean,keyword:string,code:int,instance_ref:string,schema_ref:string,error:string,message:string>"


def compile_schema(text: str, remotes=None, uri: str = "", start: str = "", mode: str | None = None) -> Schema:
    """A schema document, compiled once on the driver. Look at its ``errors``."""
    return Schema(text, remotes, uri, start, mode)


def validate(col: Column | str, schema: Schema, continue_on_error: bool = False) -> Column:
    """struct of the first error's keyword, code, places and the error objects; a text that is no JSON is not valid and
    has the parse error's message."""

    def run(text: str):
        try:
            return schema.validate(parse(text)[0], continue_on_error).to_row()
        except (ParseError, RecursionError) as e:
            return {"valid": False, "message": str(e)}

    return kernel(run, REPORT, col)


def is_valid(col: Column | str, schema: Schema, mode: str = "auto") -> Column:
    """Whether the document meets the schema. ``native``: a predicate of built-ins over the variant, where the schema
    can be compiled to one; ``exact``: the kernel; ``auto``: native if possible."""
    from leafwise.plans.predicates import Unsupported, predicate

    if mode != "exact":
        try:
            return predicate(col, schema)
        except Unsupported:
            if mode == "native":
                raise

    def run(text: str):
        try:
            return schema.validate(parse(text)[0]).valid
        except (ParseError, RecursionError):
            return False

    return kernel(run, "boolean", col)

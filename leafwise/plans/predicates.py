"""A compiled schema as one boolean Column of built-ins over the parsed variant.

Nothing is run per row in Python. What cannot be said exactly in built-ins (recursive references, enumerations of
containers, limits beyond the integers of a double, names that a variant path cannot quote) raises ``Unsupported``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from leafwise.functions import variants
from leafwise.kernel import regexes
from leafwise.kernel.lexer import Obj
from leafwise.kernel.schema import EPSILON, KINDS, TINY, Node, Schema

EXACT = 1 << 53


class Unsupported(ValueError):
    """The schema has no predicate of built-ins."""


def predicate(col: Column | str, schema: Schema) -> Column:
    """Whether the document meets the schema; false for null and for what the built-in parser refuses."""
    return F.coalesce(variants.held(F.try_parse_json(col), lambda v: v.isNotNull() & _node(schema.root, v, schema, ())), F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def _quoted(name: str) -> str:
    if any(c in "\"'\\[]" for c in name):
        raise Unsupported(f"a variant path cannot name {name!r}")
    return f'$["{name}"]'


def _limit(x) -> float:
    if isinstance(x, int) and abs(x) > EXACT:
        raise Unsupported("a limit beyond the exact integers of a double")
    return float(x)


def _node(node: Node, v: Column, schema: Schema, above: tuple) -> Column:
    if node in above:
        raise Unsupported("a recursive schema")
    above = (*above, node)
    sub = lambda n, x: _node(n, x, schema, above)
    what = variants.kind(v)
    parts: list[Column] = []
    if node.kinds != frozenset(KINDS):
        names = [k for k in KINDS if k in node.kinds and k not in ("number", "integer")] + ["integer"] * ("integer" in node.kinds) + ["double"] * ("number" in node.kinds)
        parts.append(what.isin(*names) if names else F.lit(False))
    vacuous = lambda kinds, tests: parts.append(~what.isin(*kinds) | _all(tests)) if tests else None
    vacuous(("integer", "double"), _number(node, v, what))
    vacuous(("string",), _string(node, v))
    vacuous(("array",), _array(node, v, sub))
    vacuous(("object",), _object(node, v, sub))
    if node.enum is not None:
        parts.append(_enum(node.enum_values, v, what))
    parts += [sub(n, v) for n in node.all_of]
    if node.any_of:
        parts.append(reduce(lambda a, b: a | b, [sub(n, v) for n in node.any_of]))
    if node.one_of:
        parts.append(reduce(lambda a, b: a + b, [F.coalesce(sub(n, v), F.lit(False)).cast("int") for n in node.one_of]) == 1)
    if node.negated:
        parts.append(~F.coalesce(sub(node.negated, v), F.lit(False)))
    if node.read_only and schema.mode == "write" or node.write_only and schema.mode == "read":
        parts.append(F.lit(False))
    return _all(parts)


def _number(node: Node, v: Column, what: Column) -> list[Column]:
    d, parts = F.try_variant_get(v, "$", "double"), []
    if node.minimum is not None:
        parts.append(d > _limit(node.minimum) if node.exclusive_minimum else d >= _limit(node.minimum))
    if node.maximum is not None:
        parts.append(d < _limit(node.maximum) if node.exclusive_maximum else d <= _limit(node.maximum))
    if node.multiple_of is not None:
        q = F.abs(d) / _limit(node.multiple_of)
        near = F.floor(q + 0.5)
        close = (F.abs(near - q) <= (q + near) * EPSILON) | (F.abs(near - q) < TINY)
        if isinstance(node.multiple_of, int):
            whole = F.try_variant_get(v, "$", "decimal(38,0)") % F.lit(node.multiple_of).cast("decimal(20,0)") == 0
            close = F.when(what == "integer", whole).otherwise(close)
        parts.append(close)
    return parts


def _string(node: Node, v: Column) -> list[Column]:
    s, parts = F.try_variant_get(v, "$", "string"), []
    if node.least_length is not None:
        parts.append(F.char_length(s) >= node.least_length)
    if node.most_length is not None:
        parts.append(F.char_length(s) <= node.most_length)
    if node.pattern is not None:
        parts.append(_matches(node.pattern, s))
    return parts


def _matches(pattern: str, s: Column) -> Column:
    expression, nullable = regexes.translate(pattern)
    return s.rlike(expression) | (s == "") if nullable else s.rlike(expression)


def _array(node: Node, v: Column, sub) -> list[Column]:
    items, parts = F.try_variant_get(v, "$", "array<variant>"), []
    if node.least_items is not None:
        parts.append(F.size(items) >= node.least_items)
    if node.most_items is not None:
        parts.append(F.size(items) <= node.most_items)
    if isinstance(node.items, Node):
        parts.append(F.forall(items, lambda x: sub(node.items, x)))
    elif node.items is not None:
        n = len(node.items)
        parts += [(F.size(items) <= i) | sub(x, F.get(items, F.lit(i))) for i, x in enumerate(node.items)]
        if node.extra_items is False:
            parts.append(F.size(items) <= n)
        elif isinstance(node.extra_items, Node):
            parts.append(F.forall(F.slice(items, F.lit(n + 1), F.greatest(F.size(items) - n, F.lit(0))), lambda x: sub(node.extra_items, x)))
    if node.unique:
        told = F.transform(items, lambda x: F.when(variants.is_number(x), F.concat(F.lit("n"), F.try_variant_get(x, "$", "double").cast("string"))).otherwise(F.to_json(x)))
        parts.append(F.size(F.array_distinct(told)) == F.size(told))
    return parts


def _object(node: Node, v: Column, sub) -> list[Column]:
    members = F.try_variant_get(v, "$", "map<string,variant>")
    names, parts = F.map_keys(members), []
    at = lambda k: F.try_variant_get(v, _quoted(k), "variant")  # noqa: E731  null only if missing
    for k, n in node.properties.items():
        parts.append(at(k).isNull() | sub(n, at(k)))
    parts += [at(k).isNotNull() for k in node.required if not (k in node.properties and node.properties[k].default)]
    for k, need in node.dependencies.items():
        parts.append(at(k).isNull() | (sub(need, v) if isinstance(need, Node) else _all([at(x).isNotNull() for x in need[0]])))
    if node.least_members is not None:
        parts.append(F.size(names) >= node.least_members)
    if node.most_members is not None:
        parts.append(F.size(names) <= node.most_members)
    if node.patterns or node.extra is not True:
        own = F.array(*[F.lit(k) for k in node.properties]) if node.properties else None

        def member(e: Column) -> Column:
            hits = [_matches(p, e["key"]) for p, _ in node.patterns]
            good = _all([~h | sub(n, e["value"]) for h, (_, n) in zip(hits, node.patterns, strict=True)])
            named = F.array_contains(own, e["key"]) if own is not None else F.lit(False)
            hit = reduce(lambda a, b: a | b, hits, F.lit(False))
            extra = sub(node.extra, e["value"]) if isinstance(node.extra, Node) else F.lit(node.extra)
            matched = good | extra if isinstance(node.extra, Node) else good
            return F.when(named, good).when(hit, matched).otherwise(extra)

        parts.append(F.forall(F.map_entries(members), member))
    return parts


def _enum(values: list, v: Column, what: Column) -> Column:
    if any(isinstance(x, (Obj, list)) for x in values):
        raise Unsupported("an enumeration of containers")
    strings = [x for x in values if isinstance(x, str)]
    numbers = [_limit(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    tests = [(what == "string") & F.try_variant_get(v, "$", "string").isin(*strings)] if strings else []
    tests += [variants.is_number(v) & F.try_variant_get(v, "$", "double").isin(*numbers)] if numbers else []
    tests += [what == "null"] * (None in values) + [variants.is_true(v)] * any(x is True for x in values) + [variants.is_false(v)] * any(x is False for x in values)
    return reduce(lambda a, b: a | b, tests, F.lit(False))

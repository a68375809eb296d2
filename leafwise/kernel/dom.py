"""Edits and comparisons of parsed values."""

from __future__ import annotations

from leafwise.kernel.lexer import Obj, Raw


def rebuilt(value, scalar=lambda v: v, keep=lambda name: True, order=None):
    """A copy with scalars mapped, members of refused names dropped and members ordered by a key. No recursion."""
    if not isinstance(value, list):
        return scalar(value)
    root = Obj() if isinstance(value, Obj) else []
    work = [(value, root)]
    while work:
        source, target = work.pop()
        members = source
        if isinstance(source, Obj):
            members = [m for m in source if keep(m[0])]
            if order:
                members = sorted(members, key=lambda m: order(m[0]))
        for m in members:
            child = m[1] if isinstance(source, Obj) else m
            if isinstance(child, list):
                made = Obj() if isinstance(child, Obj) else []
                work.append((child, made))
            else:
                made = scalar(child)
            target.append((m[0], made) if isinstance(source, Obj) else made)
    return root


def capitalized(value, names: bool = True):
    """Upper-case ASCII letters in all strings, member names too with ``names``."""
    table = {i: i - 32 for i in range(97, 123)}
    made = rebuilt(value, lambda v: v.translate(table) if isinstance(v, str) and not isinstance(v, Raw) else v)
    return _renamed(made, lambda k: k.translate(table)) if names else made


def _renamed(value, name):
    work = [value]
    while work:
        node = work.pop()
        if isinstance(node, Obj):
            node[:] = [(name(k), v) for k, v in node]
            work += [v for _, v in node if isinstance(v, list)]
        elif isinstance(node, list):
            work += [v for v in node if isinstance(v, list)]
    return value


def canonical(value):
    """A hashable form: equal for equal values. Objects without order, 1 like 1.0, booleans apart from numbers."""
    if isinstance(value, bool) or value is None:
        return ("l", value)
    if isinstance(value, Raw):
        return ("n", float(value))
    if isinstance(value, (int, float)):
        return ("n", value)
    if isinstance(value, str):
        return ("s", value)
    if isinstance(value, Obj):
        return ("o", frozenset((k, canonical(v)) for k, v in value), len(value))
    return ("a", tuple(canonical(v) for v in value))


def equal(a, b) -> bool:
    """Deep comparison; objects that repeat a name equal nothing."""
    if isinstance(a, Obj) and isinstance(b, Obj):
        if len({k for k, _ in a}) != len(a) or len(a) != len(b):
            return False
        return all(found and equal(v, w) for k, v in a for found, w in [b.find(k)])
    if isinstance(a, Obj) or isinstance(b, Obj):
        return False
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return not isinstance(a, list) and not isinstance(b, list) and canonical(a) == canonical(b)


def from_python(value):
    """Dicts become objects."""
    if isinstance(value, dict):
        return Obj((k, from_python(v)) for k, v in value.items())
    return [from_python(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_python(value):
    if isinstance(value, Obj):
        return {k: to_python(v) for k, v in reversed(value)}
    return [to_python(v) for v in value] if isinstance(value, list) else value

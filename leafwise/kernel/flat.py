"""Flat form: dotted paths with ``[i]`` segments and tagged scalars; and back."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

from leafwise.kernel.emit import format_double
from leafwise.kernel.lexer import Obj, Raw, kind

FLOAT_MAX = 3.4028234663852886e38


class FlatError(ValueError):
    pass


def leaves(root, exact: bool = False):
    """(path, tagged scalar) of each scalar in order; null and empty containers give nothing.

    The tag is bool, int32, int64, uint64, float, double or string. With ``exact`` doubles in float range are narrowed."""
    if not isinstance(root, Obj):
        raise FlatError("Root json must be an object")
    work = [("", root)]
    while work:
        path, value = work.pop()
        if isinstance(value, Obj):
            work += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value)]
        elif isinstance(value, list):
            if not path:
                raise FlatError("the input json can't be array here")
            work += [(f"{path}.[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
        elif value is not None:
            tag = kind(value)
            if tag == "double" and exact and abs(value) <= FLOAT_MAX:
                tag, value = "float", struct.unpack("<f", struct.pack("<f", value))[0]
            yield path, tag, value


def leaf_columns(roots, exact: bool = False):
    """The leaves of many documents as columns: (ends, good, paths, tags, values). Those of document k end at ``ends[k]``;
    it is not good if ``leaves`` refuses it or it is None."""
    paths: list[str] = []
    tags: list[str] = []
    values: list = []
    ends: list[int] = []
    good: list[bool] = []
    put_path, put_tag, put_value = paths.append, tags.append, values.append

    def leaf(path: str, value) -> None:
        tag = kind(value)
        if tag == "double" and exact and abs(value) <= FLOAT_MAX:
            tag, value = "float", struct.unpack("<f", struct.pack("<f", value))[0]
        put_path(path)
        put_tag(tag)
        put_value(value)

    def members(before: str, node: Obj) -> None:
        for k, v in node:
            t = type(v)
            path = before + k
            if t is int and -2147483648 <= v < 2147483648:
                put_path(path)
                put_tag("int32")
                put_value(v)
            elif t is str:
                put_path(path)
                put_tag("string")
                put_value(v)
            elif t is Obj:
                members(path + "." if path else path, v)
            elif t is list:
                elements(path, v)
            elif v is not None:
                leaf(path, v)

    def elements(path: str, node: list) -> None:
        if not path:
            raise FlatError("the input json can't be array here")
        for i, v in enumerate(node):
            t = type(v)
            at = f"{path}.[{i}]"
            if t is Obj:
                members(at + ".", v)
            elif t is list:
                elements(at, v)
            elif v is not None:
                leaf(at, v)

    for root in roots:
        begun, fine = len(paths), isinstance(root, Obj)
        try:
            if fine:
                members("", root)
        except (FlatError, RecursionError) as e:
            del paths[begun:], tags[begun:], values[begun:]
            fine = False
            if isinstance(e, RecursionError):
                try:
                    for path, tag, value in list(leaves(root, exact)):
                        put_path(path)
                        put_tag(tag)
                        put_value(value)
                    fine = True
                except FlatError:
                    pass
        ends.append(len(paths))
        good.append(fine)
    return ends, good, paths, tags, values


def shown(tags: list[str], values: list) -> list[str]:
    """The text of each tagged scalar, as ``primitive`` has it."""
    return [v if t == "string" else str(v) if t == "int32" else primitive(t, v)["text"] for t, v in zip(tags, values, strict=True)]


def primitive_columns(tags: list[str], values: list) -> list[list]:
    """The columns of ``primitive``, in its order."""
    both = list(zip(tags, values, strict=True))
    return [
        tags, [str(v) if t in ("string", "raw_number") else None for t, v in both], [v if t == "bool" else None for t, v in both], [v if t in ("int32", "int64") else None for t, v in both],
        [v if t == "uint64" else None for t, v in both], [v if t in ("double", "float") else None for t, v in both], shown(tags, values),
    ]


def text_of(tag: str, value) -> str:
    """The string form: doubles with six decimals."""
    if tag == "bool":
        return "true" if value else "false"
    return f"{value:.6f}" if tag in ("double", "float") else str(value)


def primitive(tag: str, value) -> dict:
    """The tagged scalar as a struct of one filled field."""
    return {
        "vtype": tag,
        "s": str(value) if tag in ("string", "raw_number") else None,
        "b": value if tag == "bool" else None,
        "i": value if tag in ("int32", "int64") else None,
        "u": value if tag == "uint64" else None,
        "d": value if tag in ("double", "float") else None,
        "text": format_double(value) if tag in ("double", "float") and abs(value) != float("inf") and value == value else text_of(tag, value),
    }


_INDEXED = re.compile(r"\[(.+)\]", re.S)


def parse_key(path: str) -> list[dict]:
    """Segments {key, index, has_array, is_index} of a flat path; an element's segment marks the name before it."""
    parts = [p for p in path.split(".") if p]
    if not parts:
        raise FlatError("bad format key of empty string")
    out: list[dict] = []
    for p in parts:
        m = _INDEXED.fullmatch(p)
        if not m:
            out.append({"key": p, "index": None, "has_array": False, "is_index": False})
            continue
        if not out:
            raise FlatError("bad format key, can not be array at root")
        if not re.fullmatch(r"[+-]?[0-9]+", m[1]):
            raise FlatError("bad index key")
        out[-1]["has_array"] = True
        out.append({"key": p, "index": int(m[1]), "has_array": False, "is_index": True})
    return out


#: ``parse_key`` of paths that come again. Not to be changed.
_key = lru_cache(10_000)(parse_key)


def unflatten(rows) -> Obj:
    """The object whose leaves are (path, value); array gaps become null, of equal paths the first counts."""
    root = Obj()
    done: set[str] = set()
    places: dict[int, dict[str, int]] = {}
    for path, value in rows:
        if path in done:
            continue
        done.add(path)
        node = root
        segments = _key(path)
        for k, s in enumerate(segments):
            last = k + 1 == len(segments)
            following = None if last else ([] if segments[k + 1]["is_index"] else Obj())
            if s["is_index"] and not isinstance(node, Obj):
                i = s["index"]
                if i < 0:
                    raise FlatError("bad index key")
                if i >= len(node):
                    node.extend([None] * (i + 1 - len(node)))
                if last:
                    node[i] = value
                elif not isinstance(node[i], list):
                    node[i] = following
                node = node[i]
                continue
            if not isinstance(node, Obj):
                raise FlatError(f"path {path} has a name where an index is")
            names = places.setdefault(id(node), {})
            at = names.get(s["key"])
            if at is None:
                names[s["key"]] = at = len(node)
                node.append((s["key"], value if last else following))
            elif last or not isinstance(node[at][1], list):
                raise FlatError(f"path {path} leads through a value")
            node = node[at][1]
    return root


def scalar_of(tag: str, text: str):
    """The value of a tagged text."""
    if tag == "bool":
        return text == "true"
    if tag in ("int32", "int64", "uint64"):
        return int(text)
    if tag in ("double", "float"):
        return float(text)
    return Raw(text) if tag == "raw_number" else text

"""JSON Pointer (RFC 6901), in string and URI fragment form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from leafwise.kernel.lexer import MISSING, Obj

# Error codes from 0.
POINTER_ERRORS = ["None", "TokenMustBeginWithSolidus", "InvalidEscape", "InvalidPercentEncoding", "CharacterMustPercentEncode"]
_INDEX = re.compile("0|[1-9][0-9]*")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
MAX_INDEX = (1 << 32) - 1


class PointerError(ValueError):
    def __init__(self, code: str, offset: int):
        super().__init__(f"{code} at {offset}")
        self.code, self.offset = code, offset


@dataclass(frozen=True)
class Pointer:
    tokens: tuple[str, ...] = ()

    @classmethod
    def parse(cls, source: str) -> Pointer:
        """Raises PointerError with the offset in the source."""
        fragment = source.startswith("#")
        at, end = int(fragment), len(source)
        if at < end and source[at] != "/":
            raise PointerError("TokenMustBeginWithSolidus", at)
        tokens: list[str] = []
        parts: list[str] = []
        held = bytearray()
        while at < end:
            c = source[at]
            if c == "/":
                if at > int(fragment):
                    tokens.append("".join(parts))
                parts, at = [], at + 1
                continue
            if fragment and c == "%":
                begun, held = at, bytearray()
                while at < end and source[at] == "%":
                    if not re.fullmatch("[0-9a-fA-F]{2}", source[at + 1 : at + 3]):
                        raise PointerError("InvalidPercentEncoding", at)
                    held.append(int(source[at + 1 : at + 3], 16))
                    at += 3
                try:
                    text = held.decode()
                except UnicodeDecodeError:
                    raise PointerError("InvalidPercentEncoding", begun) from None
                if "~" in text and re.search("~(?![01])", text + source[at : at + 1]):
                    raise PointerError("InvalidEscape", begun)
                parts.append(text.replace("~1", "/").replace("~0", "~"))
                continue
            if fragment and c not in _PLAIN and c != "~":
                raise PointerError("CharacterMustPercentEncode", at)
            if c == "~":
                if source[at + 1 : at + 2] not in ("0", "1"):
                    raise PointerError("InvalidEscape", at)
                parts.append("~" if source[at + 1] == "0" else "/")
                at += 2
                continue
            parts.append(c)
            at += 1
        if end > int(fragment):
            tokens.append("".join(parts))
        return cls(tuple(tokens))

    def __str__(self) -> str:
        return "".join("/" + t.replace("~", "~0").replace("/", "~1") for t in self.tokens)

    def fragment(self) -> str:
        """The URI fragment form."""
        return "#" + "".join(c if c in _PLAIN or c == "/" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in str(self))

    def append(self, *tokens: str | int) -> Pointer:
        return Pointer((*self.tokens, *map(str, tokens)))

    def __lt__(self, other: Pointer) -> bool:
        return self.order() < other.order()

    def order(self) -> tuple:
        """Sort key: number of tokens first, then each token's index, length and bytes."""
        missing = MAX_INDEX + 1
        return len(self.tokens), tuple((i if (i := index(t)) is not None else missing, len(t.encode()), t.encode()) for t in self.tokens)

    def get(self, root) -> tuple[bool, object, int]:
        """(found, value, number of the first token that leads nowhere or -1)."""
        node = root
        for k, token in enumerate(self.tokens):
            if isinstance(node, Obj):
                found, node = node.find(token)
                if not found:
                    return False, None, k
            elif isinstance(node, list) and (i := index(token)) is not None and i < len(node):
                node = node[i]
            else:
                return False, None, k
        return True, node, -1

    def set(self, root, value) -> tuple[object, object, bool]:
        """(new root, value there before, whether it existed). Parents on the way are made, or changed to the kind that
        the token needs: arrays are padded with nulls up to the index, "-" appends."""
        if not self.tokens:
            return value, root, True
        box = [root]
        holder, key, existed = box, 0, True
        for token in self.tokens:
            node = holder[key] if not isinstance(holder, Obj) else holder[key][1]
            if isinstance(node, list) and not isinstance(node, Obj) and (token == "-" or index(token) is not None):
                i = len(node) if token == "-" else index(token)
                if i >= len(node):
                    node.extend([None] * (i + 1 - len(node)))
                    existed = False
                holder, key = node, i
                continue
            if not isinstance(node, Obj):
                as_array = token == "-" or index(token) is not None
                made = [] if as_array else Obj()
                if isinstance(holder, Obj):
                    holder[key] = (holder[key][0], made)
                else:
                    holder[key] = made
                existed = False
                node = made
                if as_array:
                    i = 0 if token == "-" else index(token)
                    node.extend([None] * (i + 1))
                    holder, key = node, i
                    continue
            at = node.index_of(token)
            if at < 0:
                node.append((token, None))
                at, existed = len(node) - 1, False
            holder, key = node, at
        before = holder[key][1] if isinstance(holder, Obj) else holder[key]
        if isinstance(holder, Obj):
            holder[key] = (holder[key][0], value)
        else:
            holder[key] = value
        return box[0], before, existed

    def create(self, root):
        """(new root, value there, whether it existed): what is there stays, else null comes there."""
        found, value, _ = self.get(root)
        return (root, value, True) if found else (*self.set(root, None)[:2], False)

    def get_with_default(self, root, default):
        """(new root, value): ``default`` comes there if nothing was."""
        found, value, _ = self.get(root)
        return (root, value) if found else (self.set(root, default)[0], default)

    def erase(self, root) -> bool:
        """Whether it was there; the root cannot be erased."""
        if not self.tokens:
            return False
        found, parent, _ = Pointer(self.tokens[:-1]).get(root)
        if not found:
            return False
        last = self.tokens[-1]
        if isinstance(parent, Obj):
            at = parent.index_of(last)
        else:
            at = i if isinstance(parent, list) and (i := index(last)) is not None and i < len(parent) else -1
        if at >= 0:
            del parent[at]
        return at >= 0


def index(token: str) -> int | None:
    """The array index that a token of digits without leading zero names."""
    return int(token) if _INDEX.fullmatch(token) and int(token) <= MAX_INDEX - 1 else None


def traverse(root):
    """(pointer, value) of every node in document order."""
    work = [(Pointer(), root)]
    while work:
        at, value = work.pop()
        yield at, value
        if isinstance(value, Obj):
            work += [(at.append(k), v) for k, v in reversed(value)]
        elif isinstance(value, list):
            work += [(at.append(i), v) for i, v in reversed(list(enumerate(value)))]


def apart(root, tokens: tuple[str, ...]):
    """``root`` with the containers that the tokens lead through copied, so that an edit there leaves ``root`` as it is."""
    if not isinstance(root, list):
        return root
    root = node = type(root)(root)
    for token in tokens:
        i = node.index_of(token) if isinstance(node, Obj) else index(token)
        if i is None or not 0 <= i < len(node):
            break
        child = node[i][1] if isinstance(node, Obj) else node[i]
        if not isinstance(child, list):
            break
        made = type(child)(child)
        node[i] = (node[i][0], made) if isinstance(node, Obj) else made
        node = made
    return root


def node_columns(roots):
    """``traverse`` of many documents as columns: (ends, pointers as text, values)."""
    pointers: list[str] = []
    values: list = []
    ends: list[int] = []
    put_pointer, put_value = pointers.append, values.append
    escaped: dict[str, str] = {}

    def walk(at: str, v) -> None:
        put_pointer(at)
        put_value(v)
        if type(v) is Obj:
            for k, x in v:
                if (tail := escaped.get(k)) is None:
                    if len(escaped) > 10_000:
                        escaped.clear()
                    tail = escaped[k] = "/" + k.replace("~", "~0").replace("/", "~1")
                if type(x) is Obj or type(x) is list:
                    walk(at + tail, x)
                else:
                    put_pointer(at + tail)
                    put_value(x)
        elif type(v) is list:
            for i, x in enumerate(v):
                walk(f"{at}/{i}", x)

    for root in roots:
        begun = len(pointers)
        try:
            if root is not MISSING:
                walk("", root)
        except RecursionError:
            del pointers[begun:], values[begun:]
            for p, v in traverse(root):
                put_pointer(str(p))
                put_value(v)
        ends.append(len(pointers))
    return ends, pointers, values

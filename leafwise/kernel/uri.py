"""URI references (RFC 3986); parts keep their delimiters."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: scheme, authority, path, query, fragment
PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_PARTS = re.compile(PATTERN)


@dataclass(frozen=True)
class Uri:
    scheme: str
    authority: str
    path: str
    query: str
    fragment: str

    @classmethod
    def parse(cls, text: str) -> Uri:
        m = _PARTS.match(text)
        return cls(*(g or "" for g in m.groups())) if m else cls("", "", text, "", "")

    @property
    def base(self) -> str:
        return self.scheme + self.authority + self.path + self.query

    def __str__(self) -> str:
        return self.base + self.fragment

    def resolve(self, base: Uri) -> Uri:
        """This reference against ``base`` (RFC 3986 section 5.2.2)."""
        if self.scheme:
            return Uri(self.scheme, self.authority, remove_dots(self.path), self.query, self.fragment)
        if self.authority:
            return Uri(base.scheme, self.authority, remove_dots(self.path), self.query, self.fragment)
        if not self.path:
            return Uri(base.scheme, base.authority, base.path, self.query or base.query, self.fragment)
        if self.path.startswith("/"):
            path = remove_dots(self.path)
        else:
            merged = "/" + self.path if base.authority and not base.path else base.path[: base.path.rfind("/") + 1] + self.path
            path = remove_dots(merged)
        return Uri(base.scheme, base.authority, path, self.query, self.fragment)


def remove_dots(path: str) -> str:
    """RFC 3986 section 5.2.4."""
    if "." not in path:
        return path
    absolute, out = path.startswith("/"), []
    parts = path.split("/")[absolute:]
    for k, part in enumerate(parts):
        last = k + 1 == len(parts)
        if part == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif part == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" * absolute + "/".join(out)

"""URI references as Columns (RFC 3986), built-in. Parts keep their delimiters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leafwise.kernel.uri import PATTERN

PARTS = ("scheme", "auth", "path", "query", "frag")


def parse_uri(col: Column | str) -> Column:
    """struct of scheme, auth, path, query, frag, base (all but the fragment) and uri."""
    text = F.col(col) if isinstance(col, str) else col
    parts = {n: F.regexp_extract(text, PATTERN, k) for k, n in enumerate(PARTS, 1)}
    base = F.concat(*[parts[n] for n in PARTS[:4]])
    return F.when(text.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()], base.alias("base"), text.alias("uri")))


def match_uri(a: Column, b: Column, full: bool = True) -> Column:
    """Whether two parsed URIs are equal, or their bases without ``full``."""
    return a["uri"] == b["uri"] if full else a["base"] == b["base"]


def remove_dots(path: Column) -> Column:
    """RFC 3986 section 5.2.4, as a fold over the segments."""
    absolute = path.startswith("/")
    segments = F.split(F.when(absolute, F.substring(path, 2, 2147483647)).otherwise(path), "/", -1)
    step = lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(~path.contains("."), path).otherwise(F.concat(F.when(absolute, "/").otherwise(""), F.array_join(ended, "/")))


def resolve_uri(reference: Column, base: Column) -> Column:
    """The text of a parsed reference against a parsed base."""
    r, b = reference, base
    has = lambda c: c != ""
    folder = F.regexp_replace(b["path"], "[^/]*$", "")
    merged = F.when(has(b["auth"]) & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    own = has(r["scheme"]) | has(r["auth"])
    scheme = F.when(has(r["scheme"]), r["scheme"]).otherwise(b["scheme"])
    auth = F.when(own, r["auth"]).otherwise(b["auth"])
    path = F.when(own | r["path"].startswith("/"), remove_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(remove_dots(merged))
    query = F.when(own | has(r["path"]) | has(r["query"]), r["query"]).otherwise(b["query"])
    return F.concat(scheme, auth, path, query, r["frag"])

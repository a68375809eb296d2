"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three bytes, so they share at least five of
their eight positional bytes. Rows are reduced to distinct fingerprints first. A posting list of a single positional byte
would hold a 256th of all fingerprints, so the index posts four positional bytes together: fourteen keys, the blocks of
the Steiner system S(3,4,8). Every three bytes lie in exactly one block, so whatever three bytes a pair differs in, the
key of the complementary block matches. Pairs that meet under a key tally their shared positional bytes; those that reach
the guaranteed five are verified by the number of differing bits, each pair only at its first shared key.

A posting list of more than ``posting`` fingerprints would make quadratically many pairs. Its fingerprints go another,
exact way without pairs: each one of odd parity is posted under all 64-bit words within one bit of it, each of even
parity under all within two bits (a three-bit or one-bit link joins odd to even, by a word between them), and all of
them under those within one bit (two-bit links). Whoever meets under a word is linked, so each word gives a star.

Components of the links are found by alternating large-star and small-star rounds, each written to the shared folder.
Adaptive execution splits the joins of a large component's root; keys of fingerprints that many rows share are broadcast.

``deduplicated`` can go beyond three bits: near copies by 5-word shingles of a Jaccard similarity of 0.8 differ in about
seven bits of the 3-word fingerprint, out of reach of any index over 64 bits. For them a wide fingerprint of ``WIDE`` words
of 64 bits is taken over the set of a text's words, which an edit changes far less than its shingles. It is posted under
the same positional keys, fourteen a word; candidates are verified by their exact sets of 5-word shingles. Texts that have
their words, but not their shingles, in common crowd such lists; they are told apart by prefix filtering with places.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leafwise.llm.common import binary, joined, mapped, small, stored

BITS = 3
SHINGLE = 3
#: Words of the wide fingerprint. Four find 96 of 100 pairs of similarity 0.8 or more (README), six more at more cost.
WIDE = 4
#: S(3,4,8): the 14 weight-4 words of the extended Hamming code, as byte positions.
STEINER = [b for b in itertools.combinations(range(8), 4) if sum(b) % 2 == 0 and b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
SEEDS = np.random.default_rng(20).integers(0, 1 << 63, 64, np.uint64)
#: Bytes of a text that are held as words at once.
WINDOW = 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def windows(text: bytes, size: int = WINDOW) -> Iterator[list[bytes]]:
    """The lower-cased words of ``text`` in runs of about ``size`` bytes."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            cut = SPACE.search(text, stop)
            stop = cut.start() if cut else len(text)
        yield text[at:stop].lower().split()
        at = stop


def shingle_runs(text: bytes | None, k: int, digest) -> Iterator[np.ndarray]:
    """Hashes of the text's ``k``-word shingles, in runs; of the whole sequence if it is shorter; none without words."""
    carried: list[bytes] = []
    some = False
    for words in windows(text or b""):
        words = carried + words
        n = len(words) - k + 1
        if n > 0:
            some = True
            yield np.array([digest(b" ".join(words[i : i + k])) for i in range(n)], np.uint64)
        carried = words[max(0, n) :]
    if carried and not some:
        yield np.array([digest(b" ".join(carried))], np.uint64)


def _digest42(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 42)


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(votes: np.ndarray, n: int) -> int:
    return int(np.packbits((votes * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint_text(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles: a bit is 1 if set in over half of their hashes; 0 without words. The text is
    read window by window, so that a long one takes no more memory than its own bytes and one window's words."""
    votes, n = np.zeros(64, np.int64), 0
    for run in shingle_runs(text, shingle, _digest42):
        votes += _votes(run)
        n += run.size
    return _majority(votes, n)


def wide_print(text: bytes | None, words: int = WIDE) -> list[int]:
    """SimHash of the set of the text's words under ``words`` independent hashes; empty without words."""
    distinct: set[bytes] = set()
    for run in windows(text or b""):
        distinct.update(run)
    if not distinct:
        return []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    mixed = (hashes ^ SEEDS[:words, None]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    mixed = (mixed ^ (mixed >> np.uint64(32))).view(np.uint8).reshape(words, -1, 8)
    votes = np.unpackbits(mixed, axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(votes * 2 > hashes.size, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = 0) -> DataFrame:
    """(doc_id, h, fp) of every row, and ``wide`` if asked for. One narrow pass.

    ``fp`` is the fingerprint as a signed 64-bit integer, ``h`` a hash of the text that tells rows of one id apart."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        texts = [x.as_py() for x in binary(chunk.column("text"))] if chunk.num_rows == 1 else binary(chunk.column("text")).to_pylist()
        values = np.array([fingerprint_text(t) for t in texts], np.uint64)
        out = {"fp": pa.array(values.view(np.int64), pa.int64())}
        if wide:
            out["wide"] = pa.array([np.array(wide_print(t, wide), np.uint64).view(np.int64) for t in texts], pa.list_(pa.int64()))
        return out

    source = df.select(df[id_col].alias("doc_id"), F.xxhash64(df[text_col]).alias("h"), df[text_col].alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint" + (", wide array<bigint>" if wide else "")
    return mapped(source, kernel, "text", schema, ("doc_id", "h"))


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(255)


def _key(fp: Column, block: tuple[int, ...]) -> Column:
    mask = sum(255 << 8 * k for k in block)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _first(differing: Column) -> Column:
    """The first block none of whose bytes differ; ``differing`` is the exclusive or of the two."""
    out = F.lit(None).cast("int")
    for n, block in reversed(list(enumerate(STEINER))):
        out = F.when(_key(differing, block) == 0, F.lit(n)).otherwise(out)
    return out


def links(distinct: DataFrame, posting: int = 256) -> DataFrame:
    """(a, b) of distinct fingerprints, a < b: enough links to connect all that differ in at most three bits."""
    postings = distinct.select("fp", F.posexplode(F.array(*[_key(F.col("fp"), b) for b in STEINER])).alias("block", "key"))
    sizes = postings.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least"))
    shared = stored(sizes.where("n > 1"))  # most lists hold one fingerprint
    cold = postings.join(shared.where(F.col("n") <= posting).select("block", "key"), ["block", "key"])
    x, y = cold.alias("x"), cold.alias("y")
    differing = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    tally = sum((_byte(differing, k) == 0).cast("int") for k in range(8))
    met = (F.col("x.block") == F.col("y.block")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y, met & (tally >= 8 - BITS) & (F.bit_count(differing) <= BITS) & (_first(differing) <= F.col("x.block"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowded = shared.where(F.col("n") > posting).select("block", "key")
    if crowded.isEmpty():
        return pairs.distinct()
    hot = postings.join(crowded, ["block", "key"], "left_semi").select("fp").distinct()
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    bits = F.sequence(F.lit(0), F.lit(63))
    none = F.array(F.lit(0).cast("bigint"))
    near = F.concat(none, F.transform(bits, bit))
    far = F.concat(none, F.flatten(F.transform(bits, lambda i: F.transform(F.sequence(i, F.lit(63)), lambda j: bit(i).bitwiseOR(bit(j))))))  # 2,081 masks
    odd = F.bit_count("fp") % 2 == 1
    wide = hot.where(~odd).select("fp", F.explode(far).alias("mask"))
    narrow = hot.select("fp", F.explode(near).alias("mask"))
    posted = wide.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), (F.bit_count("mask") < 2).alias("close"))
    posted = posted.unionByName(narrow.where(odd).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), F.lit(True).alias("close")))
    stars = posted.groupBy("word").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1 and centre is not null")
    ends = posted.join(stars.select("word", "centre"), "word").where("fp <> centre")
    return pairs.unionByName(ends.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches, by large-star and small-star rounds.

    The rounds that are needed grow with the logarithm of a component's size; should ``rounds`` not do, it fails."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        edges = stored(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def _order() -> Column:
    """Order of the rows of a class: by id, null ids last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))


def classes(held: DataFrame, posting: int = 256) -> DataFrame:
    """(fp, n, root, first): of each fingerprint, its rows, its component and that component's first row in order."""
    distinct = stored(held.groupBy("fp").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), posting))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    return stored(placed.drop("first").join(firsts, "root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    A null or empty text has fingerprint zero and is linked like any other. Rows of equal fingerprint are one node with
    the smallest of their ids; repeated rows and ids pass as they are, null ids are no smallest (a component of null
    ids only has a null one). Long texts are read in windows. An empty table gives an empty result; other columns are
    not read."""
    held = stored(fingerprints(df, id_col, text_col))
    out = joined(held, classes(held, posting).select("fp", "n", F.col("first.doc_id").alias("component_id")), "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Beyond three bits

LEAST, LONG_SHINGLE = 0.8, 5


def _set(text: bytes | None) -> np.ndarray:
    runs = [np.unique(r) for r in shingle_runs(text, LONG_SHINGLE, xxhash.xxh3_64_intdigest)]
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, hashes): each row's set of 5-word shingles."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        return {"hashes": pa.array([_set(t).view(np.int64) for t in binary(chunk.column("text")).to_pylist()], pa.list_(pa.int64()))}

    source = df.select(df[id_col].alias("doc_id"), F.xxhash64(df[text_col]).alias("h"), df[text_col].alias("text"))
    return mapped(source, kernel, "text", f"doc_id {source.schema['doc_id'].dataType.simpleString()}, h bigint, hashes array<bigint>", ("doc_id", "h"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of items whose sets are as similar as LEAST."""
    of = lambda end: sets.select(F.col("item").alias(end), F.col("hashes").alias(f"set_{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    sizes = F.size("set_a") + F.size("set_b")
    close = F.least(F.size("set_a"), F.size("set_b")) >= LEAST * F.greatest(F.size("set_a"), F.size("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(close & (common >= LEAST * (sizes - common))).select("a", "b")


def _may(x: str, y: str) -> Column:
    """Whether sets that share their ``at``-th shingle (from 0, by one order) and none before it can be as similar as LEAST."""
    left = F.least(*[F.col(f"{k}.size") - F.col(f"{k}.at") for k in (x, y)])
    return (1 + LEAST) * left + 1e-6 >= LEAST * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _lesser() -> Column:
    """The end of a posting if it can be the smaller set of such a pair; every pair has one such end."""
    return F.when((1 + LEAST) * F.col("at") <= (1 - LEAST) * F.col("size") + 1e-6, F.struct("item", "at", "size"))


def prefixes(items: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, item, at, size): the shingles by which items are compared. Of two sets as similar as LEAST, ordered by how
    many items have a shingle, rare ones first, the first shingles hold one of both; it is posted with its place. Those of
    one item only lead to nobody, so they take places but are not posted."""
    each = sets.join(items, "item", "left_semi").select("item", F.size("hashes").alias("size"), F.explode("hashes").alias("key"))
    shared = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    ranked = each.join(small(shared), "key").groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("shared"))
    own = (F.col("size") - F.size("shared")).alias("own")
    room = F.col("size") - F.ceil(LEAST * F.col("size") - 1e-6).cast("int") + 1 - own
    first = ranked.where(room > 0).select("item", "size", own, F.posexplode(F.slice("shared", F.lit(1), room)).alias("k", "s"))
    return first.select(F.col("s.key").alias("key"), "item", (F.col("own") + F.col("k")).alias("at"), "size")


def near_copies(held: DataFrame, df: DataFrame, id_col: str, text_col: str, few: int = 16) -> DataFrame:
    """(item): rows of ``held`` (item, wide) that are near copies of an earlier one, by 5-word shingles.

    In a list of up to ``few`` rows every pair is verified. In a longer one the first row is compared with all others and
    copies that are found leave. The rows that are left in such lists share words, but not the text: they go on in lists
    of their rarest shingles (``prefixes``), which bring together all near copies and hardly any others. In long ones of
    those again only the first rows that can be the smaller of a pair are compared with all others, four times as many
    each round; copies that are found leave, as do the rows that were compared. So rounds are few, and no near copy of a
    list is left out."""
    postings = held.select("item", F.explode(F.array(*[F.xxhash64(F.lit(k), _key(F.get("wide", F.lit(k // 14)), STEINER[k % 14])) for k in range(14 * WIDE)])).alias("key"))
    # an item posts a key once (but for equal hashes, which keep a list too many), so lists are counted, not compared
    shared = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    postings = stored(postings.join(small(shared), "key", "left_semi").distinct())
    items = stored(postings.select("item", "item.doc_id", "item.h").distinct())
    texts = df.withColumn("__h", F.xxhash64(df[text_col]))
    wanted = small(items.select(F.col("doc_id").alias("__i"), F.col("h").alias("__k")).distinct())
    texts = texts.join(wanted, texts[id_col].eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k")), "left_semi")
    sets = stored(shingle_sets(texts, id_col, text_col).dropDuplicates(["doc_id", "h"]).select(_order().alias("item"), "hashes"))
    postings = postings.select("key", "item", F.lit(0).alias("at"), F.lit(0).alias("size"))
    out, leads = None, 1
    while True:
        tagged = stored(postings.join(stored(_lists(postings, leads)), "key"))
        rest = tagged.where(F.col("n") <= max(few, leads)).select("key", F.struct("item", "at", "size").alias("end"))
        x, y = rest.select("key", F.col("end").alias("x")), rest.select("key", F.col("end").alias("y"))
        near = x.join(y, "key").where((F.col("x.item") < F.col("y.item")) & _may("x", "y"))
        crowded = tagged.where(F.col("n") > max(few, leads))
        more = not crowded.isEmpty()
        if more:
            stars = crowded.select("key", F.explode("leads").alias("x"), F.struct("item", "at", "size").alias("y"))
            near = near.unionByName(stars.where((F.col("x.item") != F.col("y.item")) & _may("x", "y")))
        pairs = near.select(F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b"))
        found = stored(verified(pairs.distinct(), sets).select(F.col("b").alias("item")).distinct())
        out = found if out is None else out.unionByName(found)
        if not more:
            return out.distinct()
        left = crowded.where(~F.exists("leads", lambda lead: lead["item"] == F.col("item"))).select("key", "item", "at", "size").join(found, "item", "left_anti")
        postings = stored(left if leads > 1 else prefixes(stored(left.select("item").distinct()), sets))
        leads *= 4


def _lists(postings: DataFrame, leads: int) -> DataFrame:
    """(key, n, leads) of the lists that can hold a pair: their length and their first lesser ends. Lists are cut to parts
    for that, each of which gives its first ones."""
    if leads == 1:
        lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_compact(F.array(F.min(_lesser()))).alias("leads"))
    else:
        cut = lambda ends: F.slice(F.array_sort(ends), 1, leads)
        parts = postings.groupBy("key", F.pmod(F.xxhash64("item"), F.lit(1024)).alias("part")).agg(F.count(F.lit(1)).alias("n"), cut(F.collect_list(_lesser())).alias("some"))
        lists = parts.groupBy("key").agg(F.sum("n").alias("n"), cut(F.flatten(F.collect_list("some"))).alias("leads"))
    return lists.where((F.col("n") > 1) & (F.size("leads") > 0))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", beyond: bool = False, posting: int = 256) -> DataFrame:
    """``df`` with one document of each component, the first by id (null ids last), then by its text's hash.

    With ``beyond``, documents that stay go nevertheless if they are near copies of an earlier one that stays in its
    component: by sets of 5-word shingles of a Jaccard similarity of 0.8 or more. Rows are judged by id and text:
    rows that repeat both stay or go together, rows of one id and different texts are judged each by its text. Null and
    empty texts are one component. An empty table stays empty; further columns stay. The input is read anew for the
    result, so it must be a table or files."""
    held = stored(fingerprints(df, id_col, text_col, WIDE if beyond else 0))
    first = classes(held, posting)
    placed = joined(held.select("doc_id", "h", "fp"), first.select("fp", "n", F.col("first").alias("first")), "fp", "n")
    gone = placed.where(~_order().eqNullSafe(F.col("first"))).select("doc_id", "h")
    if beyond:
        stay = first.select("first").distinct()
        slim = held.where(F.size("wide") > 0).select(_order().alias("item"), "wide").join(stay, F.col("item").eqNullSafe(F.col("first")), "left_semi").dropDuplicates(["item"])
        gone = gone.unionByName(near_copies(stored(slim), df, id_col, text_col).select("item.doc_id", "item.h"))
    gone = small(stored(gone.distinct().select(F.col("doc_id").alias("__id"), F.col("h").alias("__gone"))))
    return df.join(gone, df[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(df[text_col]) == gone["__gone"]), "left_anti")

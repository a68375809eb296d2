"""Document fingerprints: every shingle hash below a fixed fraction of the hash range is kept.

The kept share does not depend on the text's length, so the sketches of parts merge by union and the share of one
sketch found in another estimates containment, however unequal the texts. A text none of whose hashes falls below the
threshold keeps its smallest one, so that short texts can be told apart; merging keeps that only if nothing else is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leafwise.llm.common import chunks, shuffle_partitions

SHINGLE = 5
FRACTION = 1 / 8
#: Ids for each range, of which the ranges' bounds are chosen.
SAMPLED = 100


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """XXH3 of each run of ``k`` words; of the whole sequence if it is shorter; of nothing if there are no words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= k:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    return np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def keep(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch: distinct hashes below the threshold, sorted; else the smallest."""
    if not hashes.size:
        return hashes
    low = np.unique(hashes[hashes < np.uint64(min(2**64 - 1, int(fraction * 2**64)))])
    return low if low.size else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return keep(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller set of shingles that the larger one has; two texts without words are alike."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    return float(np.intersect1d(a, b, assume_unique=True).size / min(a.size, b.size))


def to_text(sketch: np.ndarray) -> str:
    """16 lower-case hex digits for each hash, in order."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; one narrow pass. A null text is an empty one, whose fingerprint is empty."""
    from leafwise.llm.common import binary, mapped

    def kernel(chunk: pa.RecordBatch) -> dict:
        return {"fingerprint": pa.array([to_text(keep(shingle_hashes((t or b"").lower().split()))) for t in binary(chunk.column("text")).to_pylist()], pa.string())}

    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return mapped(source, kernel, "text", f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string", ("doc_id",))


def likeness(a: str | None, b: str | None) -> float:
    return containment(from_text(a or ""), from_text(b or ""))


def _pair(text: str, following: str, own: np.ndarray, words: list[bytes]) -> tuple[str, np.ndarray]:
    """The edited text and its hashes; those before the cut are taken from ``own``."""
    cut = len(text) - len(text) // 4
    edited = text[:cut] + following[: len(text) // 4]
    tail = edited.encode("utf-8", "surrogatepass").lower().split()
    same = max(0, len(text[:cut].encode("utf-8", "surrogatepass").split()) - 1) - (SHINGLE - 1)
    if same < SHINGLE or len(tail) - same < SHINGLE:
        return edited, shingle_hashes(tail)
    return edited, np.concatenate([own[:same], shingle_hashes(tail[same:])])


FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (bucket, ghost, doc_id, text): each row meets the next; a bucket's ghost row is the one after its last."""
    held, made = None, []
    for chunk in chunks(batches, "text", 256):
        kind = chunk.column("doc_id").type
        for bucket, ghost, doc_id, text in zip(*(chunk.column(k).to_pylist() for k in ("bucket", "ghost", "doc_id", "text")), strict=True):
            text = text or ""
            words = text.encode("utf-8", "surrogatepass").lower().split()
            own = shingle_hashes(words)
            row = (bucket, ghost, doc_id, text, words, own, keep(own))
            if held and not held[1] and held[0] == bucket:
                made.append(_finish(held, row))
            held = row
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate([kind, *(k for _, k in FIELDS)])], ["doc_id", *(k for k, _ in FIELDS)])
            made = []


def _finish(row: tuple, following: tuple) -> tuple:
    _, _, doc_id, text, words, own, sketch = row
    edited, hashes = _pair(text, following[3], own, words)
    other = keep(hashes)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(sketch), to_text(other), containment(sketch, other), containment(sketch, following[6])


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: its fingerprint, that of its edited text (the last quarter replaced by the start of the next
    document's), and the likeness to that and to the next document.

    Documents are dealt to ranges of the id, whose bounds come from a bounded sample and only place the work, and are
    sorted there: the texts are shuffled once, each range to a partition of its own. The first document of each range
    also goes to the range before, and the very first to the last. Ids are of any type that can be ordered; those that
    tie are ordered by text, null ids come last; a single row is its own next; a null text is an empty one. Columns
    beyond the two are not read. An empty table gives an empty result."""
    spark = df.sparkSession
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    n = shuffle_partitions(spark)
    ids = source.select("doc_id").where("doc_id is not null")
    part = min(1.0, SAMPLED * n / max(1, ids.count()))
    seen = sorted(r[0] for r in (ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else ids).collect())
    cuts = sorted({seen[len(seen) * k // n] for k in range(1, n)}) if seen else []
    kind = source.schema["doc_id"].dataType
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts])

    def dealt(ids: Column) -> Column:
        """The number of bounds up to the id: found by halving. Null ids are a range of their own, the last."""
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        onward = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= ids), at + step).otherwise(at)
        return F.when(ids.isNull(), F.lit(len(cuts) + 1)).otherwise(F.aggregate(steps, F.lit(0), onward) if cuts else F.lit(0))

    bucketed = source.withColumn("bucket", dealt(F.col("doc_id")))
    firsts = sorted((r[0], r[1]) for r in bucketed.groupBy("bucket").agg(F.min("doc_id")).collect())  # one row a range
    if not firsts:
        return spark.createDataFrame([], schema)
    before = [(firsts[(k + 1) % len(firsts)], firsts[k][0]) for k in range(len(firsts))]
    lookup = F.broadcast(spark.createDataFrame([(b, i, p) for (b, i), p in before], f"b int, first {kind.simpleString()}, previous int"))  # one row a range
    copies = bucketed.join(lookup, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    also = F.struct(F.col("previous").alias("bucket"), F.lit(1).alias("ghost"))
    rows = copies.select(F.explode(F.when(F.col("previous").isNotNull(), F.array(own, also)).otherwise(F.array(own))).alias("at"), "doc_id", "text").select("at.bucket", "at.ghost", "doc_id", "text")
    placed = rows.repartitionById(len(cuts) + 2, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_last(), "text")
    return placed.mapInArrow(_rows, schema)

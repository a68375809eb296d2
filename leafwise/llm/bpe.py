"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are cut to pre-tokens ("words") by the tokenizer's pattern once. Documents are packed into blocks; a block keeps its
distinct words and, for each document, the positions of its words among them. Blocks are stored. Their distinct words go by
hash to buckets, one packed row for each block and bucket, so that all occurrences of a word meet; a bucket encodes each
distinct word once, and its ids are joined back to the block, where documents are put together by position. Packed rows
keep the shuffle small, and a word that is everywhere is one entry a block. Words that are tokens themselves stay at home:
their ids come from the rank table.

Decoding joins the ids to the table of token bytes, a map-side join: its size is fixed by the vocabulary (about 50,000).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafwise.llm.common import chunks, shuffle_partitions, stored

#: Rows and bytes of a block; a longer text forms a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 16384, 16 << 20
#: Distinct words whose ids a bucket holds at once; beyond that it starts anew, which repeats work but changes no result.
HELD_WORDS = 1_000_000
#: Of compression: blocks lie on disk twice, as a table and in the shuffle.
LEVEL = 9


def load_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: base64 token, space, id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank, the leftmost of equals, is merged until none has a rank.

    A linked list and a heap: n log n in the word's length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], right[i] = stop, False, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[start[i] : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[start[left[i]] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


def _planes(values) -> bytes:
    """Unsigned 32-bit integers byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()


#: Ranks below it take one byte; it stands for all others, which follow in byte planes.
ESCAPE = 255


def _ranks(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers that are mostly small, so that small ones compress apart from the bytes of large ones."""
    return np.minimum(values, ESCAPE).astype(np.uint8).tobytes() + _planes(values[values >= ESCAPE] - ESCAPE)


def _from_ranks(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n, at).astype(np.uint32)
    large = out == ESCAPE
    out[large] += _from_planes(data, int(large.sum()), at + n)
    return out


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings with their sizes, compressed."""
    return zstandard.compress(struct.pack("<I", len(parts)) + _planes([len(w) for w in parts]) + b"".join(parts), LEVEL)


def _unpack(data: bytes) -> Iterator[bytes]:
    raw = zstandard.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at = 4 + 4 * n
    for size in _from_planes(raw, n, 4).tolist():
        yield raw[at : at + size]
        at += size


def _array_bytes(column: pa.Array) -> bytes:
    """A column as an Arrow stream: ids of any type travel with their block."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", column.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], ["id"]))
    return sink.getvalue().to_pybytes()


def _array_of(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(row's id, ids: array of int, round_trip: whether they decode to the text) of every row; with ``digest``
    n_tokens, ids_sha256 and decoded_sha256 instead.

    A null text has no ids (as an empty one). Ids may be of any type, null or repeated: rows are packed, not grouped by
    id. Special tokens in a text are ordinary text. The texts are read once: what is needed of them is stored, so a lost
    executor cannot change it. The rank file is read on the driver and broadcast; its size is the vocabulary's. Columns
    beyond the two are not read. An empty table gives an empty result."""
    spark: SparkSession = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    source = df.select(df[id_col].alias("row"), df[text_col].alias("text"))
    find = regex.compile(pattern)
    n = shuffle_partitions(spark)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a block (bucket null): ids, the words that are tokens, the documents' positions; and one row for each
        bucket with the words that are to be encoded there. Positions are ranks by frequency."""
        known = ranks.value
        for batch in chunks(batches, "text", BLOCK_ROWS, BLOCK_BYTES):
            block = uuid.uuid4().int >> 65
            place: dict[str, int] = {}
            sizes, digests, runs = [], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                found = find.findall(text)
                sizes.append(len(found))
                digests.append(_digest(text.encode("utf-8", "surrogatepass")))
                runs.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.uint32, len(found)))
            flat = np.concatenate(runs) if place else np.zeros(0, np.uint32)
            words = list(place)
            counts = np.bincount(flat, minlength=len(words)).tolist()
            spelled = [w.encode("utf-8", "surrogatepass") for w in words]
            goes = [0 if w in known else zlib.crc32(w) % n + 1 for w in spelled]  # 0: a token itself; else the bucket, counted from 1
            order = sorted(range(len(words)), key=lambda k: (-counts[k], goes[k], words[k]))  # frequent words get small numbers; equals lie by bucket
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            home: list[int] = []
            shares: dict[int, list[bytes]] = {}
            where = [goes[k] for k in order]
            for k in order:
                if goes[k]:
                    shares.setdefault(goes[k] - 1, []).append(spelled[k])
                else:
                    home.append(known[spelled[k]])
            keys = sorted(shares)
            head = struct.pack("<III", len(sizes), len(words), len(home)) + _planes(sizes) + b"".join(digests) + _planes(where) + _planes(home)
            data = zstandard.compress(head + _ranks(rank[flat]), LEVEL)
            packed = [_pack(shares[key]) for key in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *keys], pa.int32()), pa.array([block] * (len(keys) + 1), pa.int64()), pa.array([_array_bytes(batch.column("row")), *[None] * len(keys)], pa.binary()), pa.array([data, *packed], pa.binary())],
                ["bucket", "block", "rows", "data"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, {}
        for batch in batches:
            made = []
            for key, packed in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if key != bucket or len(held) > HELD_WORDS:
                    bucket, held = key, {}
                ids = []
                for w in _unpack(packed):
                    got = held.get(w)
                    if got is None:
                        got = held[w] = np.array(merge_word(w, ranks.value), "<u4").tobytes()
                    ids.append(got)
                made.append(_pack(ids))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("block"), batch.column("rows"), pa.array(made, pa.binary())], ["bucket", "block", "rows", "data"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block and bucket, the block's own row last: its words' ids come first."""
        spelled = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for w, i in ranks.value.items():
            spelled[i] = w
        current, ids = None, {}
        for batch in batches:
            for bucket, block, rows, data in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "rows", "data")), strict=True):
                if block != current:
                    current, ids = block, {}
                if rows is None:
                    ids[bucket] = list(_unpack(data))
                    continue
                raw = zstandard.decompress(data)
                n_docs, n_words, n_home = struct.unpack_from("<III", raw)
                at = 12
                sizes = _from_planes(raw, n_docs, at)
                at += 4 * n_docs
                digests = [raw[at + 16 * k : at + 16 * k + 16] for k in range(n_docs)]
                at += 16 * n_docs
                where = _from_planes(raw, n_words, at)
                at += 4 * n_words
                table = [b""] * n_words
                ids[-1] = [np.uint32(i).tobytes() for i in _from_planes(raw, n_home, at).tolist()]
                at += 4 * n_home
                for key, own in ids.items():
                    for k, x in zip(np.flatnonzero(where == key + 1).tolist(), own, strict=True):
                        table[k] = x
                flat = _from_ranks(raw, int(sizes.sum(dtype=np.int64)), at)
                ends = np.cumsum(sizes, dtype=np.int64)
                names = _array_of(rows)
                for first in range(0, n_docs, 256):
                    out: list[list] = [[], [], []]
                    last = min(n_docs, first + 256)
                    for k in range(first, last):
                        joined = b"".join(map(table.__getitem__, flat[ends[k] - int(sizes[k]) : ends[k]].tolist()))
                        tokens = np.frombuffer(joined, "<u4")
                        decoded = b"".join(map(spelled.__getitem__, tokens.tolist()))
                        if digest:
                            told = (tokens.size, hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest())
                        else:
                            told = (tokens.astype(np.int32), _digest(decoded) == digests[k])
                        for values, x in zip(out, told, strict=False):
                            values.append(x)
                    yield _batch(names.slice(first, last - first), out, digest)

    blocks = stored(source.mapInArrow(positions, "bucket int, block bigint, rows binary, data binary"))
    encoded = blocks.where("bucket is not null").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(once, blocks.schema)
    both = encoded.unionByName(blocks.where("bucket is null"))
    together = both.repartition(n, "block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last())
    kind = source.schema["row"].dataType.simpleString()
    out = together.mapInArrow(assemble, f"row {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else f"row {kind}, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("row", id_col)


def _batch(rows: pa.Array, out: list[list], digest: bool) -> pa.RecordBatch:
    if digest:
        kinds = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
    else:
        kinds = (("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()))
    return pa.RecordBatch.from_arrays([rows, *(pa.array(out[k], kind) for k, (_, kind) in enumerate(kinds))], ["row", *(n for n, _ in kinds)])


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table: (token, bytes)."""
    return spark.createDataFrame([(i, bytearray(w)) for w, i in load_ranks(ranks_path).items()], "token int, bytes binary")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each row's ids in order; an id without a token has none.

    The token-byte table is looked up batch by batch; it is bounded by the vocabulary. Null ids give null."""
    spelled = df.sparkSession.sparkContext.broadcast({i: w for w, i in load_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = spelled.value
            decoded = [None if ids is None else b"".join(table.get(i, b"") for i in ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(decoded, pa.binary())], ["row", "decoded"])

    source = df.select(df[id_col].alias("row"), df[ids_col].alias("ids"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {kind}, decoded binary").withColumnRenamed("row", id_col)

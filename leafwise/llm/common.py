"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and UTF-8 bytes that a kernel holds as Python objects at once. A longer text forms a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one is set, on a local master only:
    executors of a cluster would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafwise"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives a lost executor."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/leafwise-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a key table that may be broadcast; their number is counted first, more of them go through a shuffle.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds at least this part of all rows: there are at most 1,000 such keys, whatever the input.
HOT_PART = 1000


def small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (a stored table of fixed-width columns), marked for broadcast if it is counted to be small enough."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def joined(big: DataFrame, one: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``big`` (stored) to ``one`` (stored), which has one row a key and in ``n`` how many rows of ``big``
    have it. Rows of hot keys do not cross a shuffle: their keys are at most ``HOT_PART``, which are broadcast."""
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(n) * HOT_PART >= total).drop(n))
    rest = big.join(hot.select(key), key, "left_anti").join(one.where(F.col(n) * HOT_PART < total).drop(n), key)
    return big.join(hot, key).unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def binary(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string array; no copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def chunks(batches: Iterator[pa.RecordBatch], text: str, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that few rows and bytes are held as Python objects at a time."""
    for batch in batches:
        start, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def mapped(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], text: str, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` through ``kernel``, chunk by chunk: ``keep`` columns stay, the kernel's columns follow in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            made = kernel(chunk)
            yield pa.RecordBatch.from_arrays([chunk.column(k) for k in keep] + list(made.values()), [*keep, *made])

    return df.mapInArrow(run, schema)

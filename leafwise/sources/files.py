"""Files of documents and messages. All reading goes through Spark's readers."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafwise.functions import documents as D
from leafwise.functions.encodings import decode_text
from leafwise.functions.kernels import kernel
from leafwise.kernel.lexer import spans


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, file): one document a line; files are split."""
    return spark.read.text(path).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file"))


def read_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(doc, file): one document a file, in UTF-8, 16 or 32; the encoding is found by mark or zeros unless named."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(decode_text(F.col("content"), encoding).alias("doc"), F.col("path").alias("file"))


#: Documents of a file that are Python objects at once.
PART_DOCS = 10_000


def read_concatenated(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, doc_idx, doc, start, end, error): documents laid end to end in each file. A file's text is held once, its
    documents part by part."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text, file = batch.column(0)[k].as_py(), batch.column(1).slice(k, 1)
                found = enumerate(spans(text)) if text is not None else iter(())
                while part := list(islice(found, PART_DOCS)):
                    docs = [None if e else text[a:b] for _, (a, b, _, _, e) in part]
                    columns = {"file": file.take(pa.array([0] * len(part))), "doc_idx": pa.array([i for i, _ in part], pa.int32()), "doc": pa.array(docs, pa.string())}
                    columns |= {name: pa.array([x[at] for _, x in part], pa.int64()) for name, at in (("start", 2), ("end", 3))}
                    columns["error"] = pa.array([x[4] and x[4].code for _, x in part], pa.string())
                    yield pa.RecordBatch.from_pydict(columns)

    return read_files(spark, path, encoding).select("doc", "file").mapInArrow(run, "file string, doc_idx int, doc string, start bigint, end bigint, error string")


def widened(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer (as a file of one row group has): kernels run at
    the speed of their tasks' cores. A table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_lines(df: DataFrame, path: str, col: str = "doc", compact: bool = True) -> None:
    """One document a line; ``compact`` first takes out white space, so that none holds a line end."""
    df.select(D.condense(col) if compact else F.col(col)).write.text(path)


def _frames(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = shift = 0
        while True:
            if at >= len(data):
                return out
            b = data[at]
            at += 1
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        if at + size > len(data):
            return out
        out.append(data[at : at + size])
        at += size
    return out


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(msg, file): messages with their length as a varint before each; a message that is cut off ends its file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.explode(kernel(_frames, "array<binary>", "content")).alias("msg"), F.col("path").alias("file"))


def framed(col: Column | str) -> Column:
    """A message with its length as a varint before it."""

    def run(data: bytes) -> bytes:
        size, head = len(data), bytearray()
        while size > 127:
            head.append(size & 127 | 128)
            size >>= 7
        head.append(size)
        return bytes(head) + data

    return kernel(run, "binary", col)


def cursor(col: Column, offset: Column) -> Column:
    """(line, column), both from 1, of a byte offset in a text; built-in."""
    before = F.decode(F.substring(F.encode(col, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


__all__ = ["cursor", "framed", "read_concatenated", "read_files", "read_lines", "read_messages", "widened", "write_lines"]

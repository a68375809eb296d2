"""Document columns on streams: the same Columns, around which Spark keeps offsets, state and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwise.functions import documents as D, schemas
from leafwise.kernel.schema import Schema
from leafwise.operators.documents import flatten_rows


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(doc): one document a line of the files that arrive in a folder."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path).select(F.col("value").alias("doc"))


def read_table(spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def flatten_stream(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Leaves of each document; stateless."""
    return flatten_rows(df, col, keep)


def windowed_values(df: DataFrame, col: str, time: str, keys: list[str], late: str = "1 hour", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Leaves counted and summed by window, keys and path. Rows later than ``late`` behind the watermark are left out."""
    marked = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = flatten_rows(marked, col, [time, *keys])
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    number = F.col("value").try_cast("double")
    return rows.groupBy(frame.alias("w"), *keys, "path").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total")).select(F.col("w.start").alias("start"), *keys, "path", "n", "total")


def session_counts(df: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows by session of activity."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def route(df: DataFrame, col: str, schema: Schema, good: str, bad: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes documents that meet the schema to ``good`` and the others with their report to ``bad``, as Parquet. A
    batch that is run again writes to the same folders of its number, so that nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("report", schemas.validate(col, schema)).persist()
        try:
            judged.where("report.valid").drop("report").write.mode("overwrite").parquet(f"{good}/batch={number}")
            judged.where("report is null or not report.valid").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            judged.unpersist()

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what has arrived to the end and reads the result. ``complete`` replaces the table with each batch."""
    spark = df.sparkSession
    schema = df.schema
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def status_counts(df: DataFrame, col: str) -> DataFrame:
    """Documents by parse status; a stateful count."""
    return df.groupBy(D.parse_status(col)["code"].alias("code")).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["flatten_stream", "read_lines", "read_table", "route", "run_to_table", "session_counts", "status_counts", "windowed_values"]

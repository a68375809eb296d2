"""DataFrame operators around document columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafwise.functions import documents as D, schemas
from leafwise.kernel.schema import Schema
from leafwise.options import FlattenOptions
from leafwise.plans import flat


def flatten_rows(df: DataFrame, col: str, keep: list[str], mode: str = "kernel", options: FlattenOptions = FlattenOptions(), schema=None) -> DataFrame:
    """One row for each leaf: keep, path, value (and ord, vtype with the kernel).

    ``kernel`` is exact and keeps order; ``static`` is a projection by ``schema`` (found from the data if None, for
    which the data must share one); ``recursive`` takes any object, built-in. None of them shuffles."""
    if mode == "static":
        schema = schema or flat.closed_schema(df, col)
        if schema is None:
            raise ValueError("the documents share no closed schema: use the kernel or the recursive mode")
        return flat.flatten_static(df, col, schema, keep)
    if mode == "recursive":
        return flat.flatten_recursive(df, col, keep)
    return df.select(*keep, F.explode(D.flatten(col, options)).alias("e")).select(*keep, "e.ord", "e.path", "e.vtype", "e.value")


def first_of_path(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Of rows of one path within a document, the first."""
    order = W.partitionBy(*keep, "path").orderBy("ord")
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def path_stats(rows: DataFrame) -> DataFrame:
    """What the paths hold, array positions taken together: rows, documents' least and greatest values, kinds."""
    path = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    return rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value").alias("about_distinct"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def unflatten_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, doc): documents of rows of (keep, ord, path, vtype, value)."""
    entries = F.collect_list(F.struct("ord", "path", "vtype", "value")).alias("entries")
    return rows.groupBy(*keep).agg(entries).select(*keep, D.unflatten("entries").alias("doc"))


def doc_diff(a: DataFrame, b: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Leaves of either side only: keep, path, value, side (left or right)."""
    sides = [flatten_rows(x, col, keep).select(*keep, "path", "value", F.lit(n).alias("__n")) for x, n in ((a, 1), (b, -1))]
    # counted once for both directions: what is left over is of one side
    over = sides[0].unionByName(sides[1]).groupBy(*keep, "path", "value").agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "left").otherwise("right").alias("side")
    return over.select(*keep, "path", "value", F.explode(F.array_repeat(side, F.abs("__n").cast("int"))).alias("side"))


def traverse_rows(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """One row for each node: keep, ord, pointer, kind."""
    return df.select(*keep, F.explode(D.traverse(col)).alias("e")).select(*keep, "e.*")


def split_rows(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """One row for each document laid end to end in a text: keep, doc_idx, text, start, end, error."""
    return df.select(*keep, F.explode(D.split_docs(col)).alias("e")).select(*keep, "e.*")


def token_rows(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """One row for each parse event."""
    return df.select(*keep, F.explode(D.tokens(col)).alias("e")).select(*keep, "e.*")


def validated(df: DataFrame, col: str, schema: Schema, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows that meet the schema, the others with a ``report``). Only the others go through the error kernel."""
    judged = df.withColumn("__valid", schemas.is_valid(col, schema, mode))
    return judged.where("__valid").drop("__valid"), judged.where(~F.coalesce("__valid", F.lit(False))).drop("__valid").withColumn("report", schemas.validate(col, schema, True))


def nested(parent: DataFrame, child: DataFrame, on: Column, key: str, child_key: str, name: str, fields: list[Column], order: list[str]) -> DataFrame:
    """``parent`` with an array ``name`` of its children's ``fields``, ordered: rows to documents. Children are grouped
    by key before the join, which then reuses their partitioning."""
    lists = child.groupBy(child_key).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("__v")))).alias("__l"))
    return parent.join(lists, on).withColumn(name, F.transform("__l", lambda x: x["__v"])).drop("__l", child_key)

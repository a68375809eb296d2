"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafwise.llm import bpe, html_extract, pii, simhash, sketch, warc
from leafwise.llm.langid import predict, train
from leafwise.llm.license_scan import scan_licenses
from leafwise.llm.mixing import mix
from leafwise.llm.quality import score_quality


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find_pii(documents(spark, sf_dir)).drop("found")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of a crawl of the pages with the response that it resolves to."""
    out = warc.resolve_revisits(warc.captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("headers", warc.header_text(F.col("headers")))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return sketch.edited_neighbours(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    return bpe.encode(documents(spark, sf_dir), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, digest=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, base rules and the weak-supervision verdict of every document."""
    return score_quality(documents(spark, sf_dir))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by models that the held-out quarter had no part in."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(docs.doc_id) & docs.doc_id.isNotNull()))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_html_main_text": op4_html_main_text,
    "op5_simhash": op5_simhash,
    "op6_scaled_sketch": op6_scaled_sketch,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_source_mix": op10_source_mix,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_warc_revisits": warc.REVISITS_SQL}

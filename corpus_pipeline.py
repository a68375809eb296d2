"""A corpus pipeline of five operators: documents in, token ids out.

Each stage's result is written as Parquet in the shared folder and reread as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafwise.llm import bpe, langid, mixing, pii, simhash
from leafwise.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the models know; models are fitted on a bounded sample of the labelled rows.

    Null, empty and letterless texts are of no language and go; with no labelled row all go. Repeated rows and null ids
    are judged alike; an empty table stays empty; further columns stay, whatever their names."""
    judged = langid.predict(docs, langid.train(docs), keep=tuple(docs.columns), prefix="__judged_")
    return judged.where("not __judged_rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of op5's near copies (fingerprints within three bits), that of the smallest id; of those,
    none that is a near copy by 5-word shingles (similarity 0.8 or more) of an earlier one.

    Rows of one id and text stay or go together; a null id comes last; texts without words are one group. An empty table
    stays empty; further columns stay."""
    return simhash.deduplicated(docs, beyond=True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows.

    Null texts stay null and empty ones empty; rows, ids and further columns stay as they are. An empty table stays
    empty."""
    clean = pii.redact(docs)
    return clean.select(*[F.length("text").cast(clean.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each round.

    Null texts and those without words have size 0 and are not taken; null sources form one source. Rows of one id are
    taken alike. An empty table stays empty; further columns stay."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text.

    A null text has no ids; repeated rows and null ids stay; an empty table stays empty; further columns are not read."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Models, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

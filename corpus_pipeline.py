"""Five stages over ``documents``: drop toxic documents, near copies and benchmark leaks, mask personal data, tokenize.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  All but the last return the columns
of ``documents``.  No stage can be expressed in SQL as a whole (trained models, tokenizer), so there is no ORACLE_SQL; the
tests hold the stages against brute force.

Null texts stay through all stages (no terms, no shingles, no windows, no data, no ids), rows without doc_id too; of rows
that share a doc_id one stays.  Empty tables give empty results.  Other columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillweave.llm import bpe, decontaminate, jaccard, pii, toxicity
from skillweave.llm.queries import vocabulary_path
from skillweave.llm.shared import write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind; n_chars is counted anew."""
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text."""
    return bpe.encode(docs, vocabulary_path("word_bpe_49k.json"), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: No stage is expressible in SQL on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs

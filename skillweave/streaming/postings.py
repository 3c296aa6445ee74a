"""Streaming extensions: postings are labelled as they come, and relation records are folded into a running fused table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave import schema
from skillweave.functions import text as fx
from skillweave.operators import fusion


def posting_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.POSTING).json(path)


def sentence_stream(postings: DataFrame) -> DataFrame:
    """Stateless: id, lang, text, tokens of every sentence, and the attribute rules over it."""
    rows = postings.select(F.col("id").alias("posting"), "lang", F.posexplode(fx.sentences(F.col("description"))).alias("sent_ord", "text"))
    text = F.col("text")
    return rows.select(
        F.concat_ws("#", "posting", "sent_ord").alias("id"), "lang", "text", fx.tokens(text).alias("tokens"), fx.proficiency(text).alias("proficiency_level"), fx.essential(text).alias("essential"), fx.experience_years(text).alias("experience_years")
    )


def evidence_stream(records: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Evidence per (head_id, relation, tail_id) and event-time window; ``records`` need an ingest timestamp ``ts``."""
    return records.withWatermark("ts", delay).groupBy(F.window("ts", window), "head_id", "relation", "tail_id").agg(F.sum("evidence_count").alias("evidence_count"), F.bool_or("essential").alias("essential"), F.max("experience_years").alias("experience_years"))


def upsert_fused(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each micro-batch is fused with the stored table and written as the next version.

    A version is named by its batch, so a batch that runs again writes the same version: exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["head_id", "head_text", "head_type", "relation", "tail_id", "tail_text", "tail_type", "essential", "evidence_count", "proficiency_level", "experience_years", "sentence_ids", "ord"]
        fresh = batch.withColumn("sentence_ids", F.array("sentence_id")).select(columns)
        if batch_id > 0:
            fresh = spark.read.parquet(f"{path}/v{batch_id - 1}").select(columns).unionByName(fresh)
        fusion.fuse_relations(fresh).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write

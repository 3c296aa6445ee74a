"""Fusing relation records into nodes and edges.  ``ord`` (rel_ord) carries the order that decides ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions import text as fx
from skillweave.schema import PROFICIENCY_RANK, SOURCE_PRIORITY


def proficiency_rank(level: Column) -> Column:
    out = F.lit(-1)
    for name, rank in PROFICIENCY_RANK.items():
        out = F.when(level == name, F.lit(rank)).otherwise(out)
    return out


def source_priority(source: Column) -> Column:
    out = F.when(source.isNull(), F.lit(0)).otherwise(F.lit(1))
    for name, rank in SOURCE_PRIORITY.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return out


def fuse_relations(records: DataFrame) -> DataFrame:
    """One row per (head_id, relation, tail_id): evidence summed (none counts 1), essential if any (unsaid is essential),
    highest proficiency, most years.

    Records: head_id, head_text, head_type, relation, tail_id, tail_text, tail_type, essential, evidence_count,
    proficiency_level, experience_years, ord, and sentence_id or, where they are fused already, sentence_ids.  Head and tail text come from the first record, and so do the
    structs ``head`` and ``tail`` (offsets, score) where the records have them.
    """
    sides = [c for c in ("head", "tail") if c in records.columns]
    sentences = F.col("sentence_ids") if "sentence_ids" in records.columns else F.array("sentence_id")
    level = F.when(F.col("proficiency_level").isNotNull(), F.struct(proficiency_rank(F.col("proficiency_level")).alias("rank"), (-F.col("ord")).alias("first")))
    return (
        records.groupBy("head_id", "relation", "tail_id")
        .agg(
            F.sum(F.coalesce(F.nullif(F.col("evidence_count"), F.lit(0)), F.lit(1))).cast("long").alias("evidence_count"),
            F.bool_or(F.coalesce("essential", F.lit(True))).alias("essential"),
            F.max_by("proficiency_level", level).alias("proficiency_level"),
            F.max("experience_years").alias("experience_years"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", sentences.alias("ids")))), lambda x: x["ids"])).alias("sentence_ids"),
            F.min_by(F.struct("head_text", "head_type", "tail_text", "tail_type", *sides), "ord").alias("first"),
            F.min("ord").alias("ord"),
        )
        .select("head_id", "relation", "tail_id", "evidence_count", "essential", "proficiency_level", "experience_years", "sentence_ids", "first.*", "ord")
    )


def _sides(records: DataFrame) -> DataFrame:
    extra = "source" if "head_source" in records.columns else None

    def side(name: str, k: int) -> DataFrame:
        source = F.col(f"{name}_source") if extra else F.lit(None).cast("string")
        return records.select(F.col(f"{name}_id").alias("id"), F.col(f"{name}_text").alias("text"), F.col(f"{name}_type").alias("entity_type"), source.alias("source"), (F.col("ord") * 2 + k).alias("ord"))

    return side("head", 0).unionByName(side("tail", 1))


def fuse_nodes(records: DataFrame) -> DataFrame:
    """One row per node id: the source of highest priority (the first on ties), sorted distinct names, first type and order.

    Equal mentions are counted down to their first one before anything else, as there are many of a node.
    """
    mentions = _sides(records).groupBy("id", "text", "entity_type", "source").agg(F.min("ord").alias("ord"))
    return mentions.groupBy("id").agg(
        F.min_by("entity_type", "ord").alias("entity_type"),
        F.max_by("source", F.struct(source_priority(F.col("source")).alias("p"), (-F.col("ord")).alias("first"))).alias("source"),
        F.array_sort(F.collect_set("text")).alias("alt_names"),
        F.min_by("text", "ord").alias("text"),
        F.min("ord").alias("node_ord"),
    )


def fusion_stats(nodes: DataFrame, fused: DataFrame) -> DataFrame:
    """merged_entities, merged_relations, merged_alt_names in one row."""
    a = nodes.agg(F.count("*").alias("merged_entities"), F.coalesce(F.sum(F.size("alt_names")), F.lit(0)).alias("merged_alt_names"))
    b = fused.agg(F.count("*").alias("merged_relations"))
    return a.join(F.broadcast(b), F.lit(True)).select("merged_entities", "merged_relations", "merged_alt_names")


def with_ids(relations: DataFrame) -> DataFrame:
    """Aligned relations (head, tail structs, doc_ord, span_ord) as flat records for fusion."""
    out = relations
    for side in ("head", "tail"):
        out = out.withColumn(f"{side}_id", fx.node_id(F.col(f"{side}.canonical_id"), F.col(f"{side}.entity_type"), F.col(f"{side}.text")))
        out = out.withColumn(f"{side}_text", F.col(f"{side}.text")).withColumn(f"{side}_type", F.col(f"{side}.entity_type")).withColumn(f"{side}_source", F.col(f"{side}.source"))
    # Decimal: places in large inputs times spans don't fit 64 bits.
    place = F.col("doc_ord").cast("decimal(38,0)") * F.lit(100_000) + F.col("span_ord")
    return out.withColumn("ord", place.cast("decimal(38,0)")).withColumn("sentence_id", F.col("id"))

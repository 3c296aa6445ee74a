"""The occupation-skill ontology: entity types, relations, edge attributes, label space, and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ontology.
ENTITY_TYPES = ("OCC", "SKL", "KNW", "ABL", "TSK", "TOL", "QLF")
RELATION_OF_TYPE = {
    "SKL": "REQUIRES_SKILL",
    "KNW": "REQUIRES_KNOWLEDGE",
    "ABL": "REQUIRES_ABILITY",
    "TSK": "HAS_TASK",
    "TOL": "USES_TOOL",
    "QLF": "REQUIRES_QUALIFICATION",
}
RELATIONS = {**{name: ("OCC", kind) for kind, name in RELATION_OF_TYPE.items()}, "PREREQUISITE_OF": ("SKL", "SKL"), "SIMILAR_TO": ("OCC", "OCC")}
EDGE_ATTRIBUTES = {"essential": "bool", "evidence_count": "int", "proficiency_level": "string", "experience_years": "float"}
PROFICIENCY_RANK = {"expert": 3, "proficient": 2, "familiar": 1, "basic": 0}
SOURCE_PRIORITY = {"human": 4, "ESCO": 3, "O*NET": 2, "distant": 1}

POSTING = "id string, lang string, title string, description string"
GAZETTEER = "canonical_id string, entity_type string, term string, source string, description string, aliases array<string>, metadata map<string,string>"
NER_EXAMPLE = "id string, lang string, text string, tokens array<string>, labels array<string>, metadata map<string,string>"
NODE = "id string, label string, name string, entity_type string, source string, alt_names string"
EDGE = "source string, target string, relation string, essential boolean, evidence_count bigint, proficiency_level string, experience_years double"
RELATION_EXAMPLE = "text string, head string, tail string, relation string"
TEXT_SCAN = "id string, text string"


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def bio_labels() -> list[str]:
    """``O``, then B- and I- of every entity type."""
    return ["O", *[f"{mark}-{kind}" for kind in ENTITY_TYPES for mark in ("B", "I")]]


def relation_table(spark: SparkSession) -> DataFrame:
    """relation, source_type, target_type."""
    return spark.createDataFrame([(name, a, b) for name, (a, b) in sorted(RELATIONS.items())], "relation string, source_type string, target_type string")


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose relation or endpoint types break the ontology: source, target, relation, source_type, target_type."""
    kinds = nodes.select("id", "entity_type")
    typed = (
        edges.select("source", "target", "relation")
        .join(kinds.select(F.col("id").alias("source"), F.col("entity_type").alias("source_type")), "source", "left")
        .join(kinds.select(F.col("id").alias("target"), F.col("entity_type").alias("target_type")), "target", "left")
    )
    allowed = F.broadcast(relation_table(edges.sparkSession))  # as many rows as the ontology has relations
    return typed.join(allowed, ["relation", "source_type", "target_type"], "left_anti").select("source", "target", "relation", "source_type", "target_type")

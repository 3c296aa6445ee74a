"""Writers: JSON lines, node and edge CSV, reports, graph tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.operators.graph import check_endpoints
from skillweave.session import materialise


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """CSV in node order."""
    ordered = nodes.orderBy("node_ord", "id") if "node_ord" in nodes.columns else nodes
    ordered.select("id", "label", "name", "entity_type", "source", "alt_names").write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """CSV; booleans as True and False, missing values empty."""
    flag = F.when(F.col("essential"), "True").when(~F.col("essential"), "False")
    edges.withColumn("essential", flag).select("source", "target", "relation", "essential", "evidence_count", "proficiency_level", "experience_years").write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The native store: nodes, and edges partitioned by relation, so that queries read only the relations they need."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def write_report(row: DataFrame, path: str) -> None:
    """One collected row as a JSON file on the driver."""
    found = row.first()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found.asDict(recursive=True) if found else {}, f, ensure_ascii=False, indent=2)


def fused_json(fused: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Fused relations with head, tail and attributes nested.

    Where ``fused`` has the first record's structs, a side holds all their fields (offsets, score); with ``nodes`` (of
    ``fuse_nodes``) its source and names are the fused node's.
    """
    out = fused
    for side in ("head", "tail"):
        if side in fused.columns:
            fields = [F.col(f"{side}.{f}").alias("type" if f == "entity_type" else f) for f in fused.schema[side].dataType.names if f != "source" or nodes is None]
        else:
            fields = [F.col(f"{side}_text").alias("text"), F.col(f"{side}_type").alias("type"), F.col(f"{side}_id").alias("canonical_id")]
        if nodes is not None:
            out = out.join(nodes.select(F.col("id").alias(f"{side}_id"), F.struct("source", "alt_names").alias("_node")), f"{side}_id", "left")
            fields += [F.col("_node.source").alias("source"), F.col("_node.alt_names").alias("alt_names")]
        out = out.withColumn(f"_{side}", F.struct(*fields)).drop("_node")
    attributes = F.struct("essential", "evidence_count", "proficiency_level", "experience_years")
    return out.select("relation", F.col("_head").alias("head"), F.col("_tail").alias("tail"), attributes.alias("attributes"), "sentence_ids")


def _last(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_fresh", "_ord", *values)).alias("x")).select(*keys, "x.*")


def merge_graph(nodes: DataFrame, edges: DataFrame, path: str, version: int) -> None:
    """Upsert into the graph stored as ``path/v{version - 1}``, written as ``path/v{version}``; 0 starts a store.

    A node is known by its id and takes name, entity_type and source of the last row; an edge is known by source, relation
    and target and takes all attributes of the last row; edges that miss an endpoint are dropped.  A version is written
    from the one before, so writing it again after a failure gives the same.
    """
    spark = nodes.sparkSession
    node, key, attributes = ["name", "entity_type", "source"], ["source", "relation", "target"], ["essential", "evidence_count", "proficiency_level", "experience_years"]

    def fresh(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("_fresh", F.lit(1)).withColumn("_ord", F.col(order).cast("decimal(38,0)") if order in df.columns else F.lit(0).cast("decimal(38,0)"))

    def with_stored(df: DataFrame, name: str) -> DataFrame:
        if version == 0:
            return df
        stored = spark.read.parquet(f"{path}/v{version - 1}/{name}").withColumn("_fresh", F.lit(0)).withColumn("_ord", F.lit(0).cast("decimal(38,0)"))
        return df.unionByName(stored.select(df.columns))

    every_node = with_stored(fresh(nodes, "node_ord").select("id", *node, "_fresh", "_ord"), "nodes")
    _last(every_node, ["id"], node).write.mode("overwrite").parquet(f"{path}/v{version}/nodes")
    known = spark.read.parquet(f"{path}/v{version}/nodes")
    every_edge = with_stored(fresh(edges, "edge_ord").select(*key, *attributes, "_fresh", "_ord"), "edges")
    check_endpoints(_last(every_edge, key, attributes), known).write.mode("overwrite").partitionBy("relation").parquet(f"{path}/v{version}/edges")


BUCKETS = 64
_STORE = {
    "nodes": (["id"], ["name", "entity_type", "source"], "node_ord"),
    "edges": (["source", "relation", "target"], ["essential", "evidence_count", "proficiency_level", "experience_years"], "edge_ord"),
}


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, dict[int, int]]:
    """For each table, which version last wrote each bucket: at most ``BUCKETS`` entries."""
    out: dict[str, dict[int, int]] = {"nodes": {}, "edges": {}}
    if version >= 0:
        for r in spark.read.parquet(f"{path}/manifest/v{version}").collect():
            out[r.name][r.bucket] = r.version
    return out


def _buckets(spark: SparkSession, path: str, name: str, where: dict[int, int], only: set[int] | None = None) -> DataFrame | None:
    paths = [f"{path}/{name}/v{v}/bucket={b}" for b, v in sorted(where.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def stored_graph(spark: SparkSession, path: str, version: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(nodes, edges) of a version of a bucketed store; None for a table without rows."""
    where = _manifest(spark, path, version)
    return tuple(_buckets(spark, path, name, where[name]) for name in _STORE)


def upsert_graph(nodes: DataFrame, edges: DataFrame, path: str, version: int) -> None:
    """``merge_graph`` into a store of buckets by key hash: only the buckets that get a row are written again.

    Every version has a manifest that says which version holds each bucket.  Files are never changed, so a version that is
    written again after a failure is the same, and a reader of an older one isn't disturbed.
    """
    spark = nodes.sparkSession
    where = _manifest(spark, path, version - 1)
    for name, fresh in (("nodes", nodes), ("edges", edges)):
        keys, values, order = _STORE[name]
        ord_ = (F.col(order) if order in fresh.columns else F.lit(0)).cast("decimal(38,0)").alias("_ord")
        rows = fresh.select(*keys, *values, ord_, F.lit(1).alias("_fresh"))
        if name == "edges":
            known = _buckets(spark, path, "nodes", where["nodes"])
            rows = check_endpoints(rows, known if known is not None else nodes.limit(0))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        rows = materialise(rows.withColumn("bucket", bucket))
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}
        if not touched:
            continue
        before = _buckets(spark, path, name, where[name], touched)
        if before is not None:
            old = before.select(*keys, *values, F.lit(0).cast("decimal(38,0)").alias("_ord"), F.lit(0).alias("_fresh")).withColumn("bucket", bucket)
            rows = rows.unionByName(old)
        merged = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*values), F.struct("_fresh", "_ord", *values)).alias("x")).select("bucket", *keys, "x.*")
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/v{version}")
        where[name] |= dict.fromkeys(touched, version)
    entries = [(name, b, v) for name, held in where.items() for b, v in sorted(held.items())]
    spark.createDataFrame(entries, "name string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")


def experiment_markdown(sizes: dict[str, int], coverage: dict, scores: dict[str, dict[str, dict]]) -> str:
    """The written report of tagger experiments.

    ``sizes``: examples of train, dev and test; ``coverage``: a row of ``evaluation.coverage``; ``scores``: for each
    experiment its dev and test row ``micro`` of ``evaluation.entity_scores``.  The last experiment is compared with the first.
    """

    def block(title: str, lines: list[tuple[str, object]], level: int = 2) -> str:
        return "\n".join([f"{'#' * level} {title}", "", *[f"- {name}: {value}" for name, value in lines]]).rstrip() + "\n"

    names = list(scores)
    first, last = (scores[n]["test"]["f1"] for n in (names[0], names[-1]))
    parts = ["# CRF Formal Experiment Report\n", block("Dataset", [(f"{k.capitalize()} examples", n) for k, n in sizes.items()])]
    parts.append(block("JD Coverage", [("Documents", coverage["docs"]), ("Documents with gazetteer hits", coverage["docs_with_hits"]), ("Coverage ratio", coverage["ratio"])]))
    parts.append(block("Results", []))
    for n in names:
        dev, test = scores[n]["dev"], scores[n]["test"]
        parts.append(block(n, [("Dev F1", dev["f1"]), ("Test F1", test["f1"]), ("Test Precision", test["precision"]), ("Test Recall", test["recall"])], 3))
    parts.append(block("Comparison", [(f"{names[0]} test F1", first), (f"{names[-1]} test F1", last), ("Delta F1", round(last - first, 4))]))
    return "\n".join(parts)

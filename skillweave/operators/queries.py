"""The questions a graph answers, as DataFrame -> DataFrame.  ``nodes`` and ``edges`` carry node_ord and edge_ord for ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import text as fx
from skillweave.operators import graph

NEEDED = ("REQUIRES_SKILL", "USES_TOOL", "REQUIRES_KNOWLEDGE")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """num_nodes, num_edges, relations (sorted)."""
    a = nodes.agg(F.countDistinct("id").alias("num_nodes"))
    b = edges.agg(F.count("*").alias("num_edges"), F.array_sort(F.collect_set("relation")).alias("relations"))
    return a.join(F.broadcast(b), F.lit(True)).select("num_nodes", "num_edges", "relations")  # one row each


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("num_edges"))


def top_edges(edges: DataFrame, limit: int = 1200, include_similarity: bool = False) -> DataFrame:
    """The edges of most evidence, ties by edge order."""
    own = edges if include_similarity else edges.filter(F.col("relation") != "SIMILAR_TO")
    return own.orderBy(F.desc(F.coalesce("evidence_count", F.lit(0))), "edge_ord", "source", "target").limit(max(0, limit))


def subgraph(nodes: DataFrame, edges: DataFrame, limit: int = 1200, include_similarity: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the strongest edges and their endpoints."""
    kept = top_edges(edges, limit, include_similarity)
    ends = kept.select(F.col("source").alias("id")).unionByName(kept.select(F.col("target").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi").select("id", "name", "entity_type"), kept


def subgraph_totals(nodes: DataFrame, edges: DataFrame, limit: int = 1200, include_similarity: bool = False) -> DataFrame:
    """One row: nodes and edges shown by ``subgraph``, all nodes and edges there are, and whether edges were left out."""
    shown_nodes, shown_edges = subgraph(nodes, edges, limit, include_similarity)
    parts = [
        shown_nodes.agg(F.count("*").alias("shown_nodes")),
        shown_edges.agg(F.count("*").alias("shown_edges")),
        nodes.agg(F.count("*").alias("total_nodes")),
        edges.agg(F.count("*").alias("total_edges")),
    ]
    row = reduce(lambda x, y: x.join(F.broadcast(y), F.lit(True)), parts)  # one row each
    return row.withColumn("is_limited", F.col("shown_edges") < F.col("total_edges"))


def find_occupation(nodes: DataFrame, name: str, loose: bool = True) -> DataFrame:
    """id of the first occupation (node order) of a name: exact, as displayed, or, if ``loose``, inside its other names."""
    needle = "".join(name.lower().split())
    occ = nodes.filter(F.col("entity_type") == "OCC")
    key = fx.name_key(F.col("name"))
    match = key == needle
    if loose:
        shown = fx.name_key(fx.display_name(F.col("name"), F.coalesce("alt_names", F.lit(""))))
        match = match | (shown == needle)
        if needle:
            match = match | F.contains(fx.name_key(F.coalesce("alt_names", F.lit(""))), F.lit(needle))
    return occ.filter(match).orderBy("node_ord", "id").limit(1).select("id", "name")


def occupation_profile(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """relation, target, target_type, evidence_count by relation and falling evidence."""
    own = edges.join(F.broadcast(find_occupation(nodes, name).select(F.col("id").alias("source"))), "source")
    named = own.join(nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("entity_type").alias("target_type")), "target", "left")
    return named.select("relation", F.coalesce("target_name", "target").alias("target"), "target_type", F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"), "edge_ord").orderBy("relation", F.desc("evidence_count"), "edge_ord").drop("edge_ord")


def _weighted(nodes: DataFrame, edges: DataFrame, skills: list[str], default: int) -> DataFrame:
    own = edges.filter(F.col("relation").isin(*NEEDED)).join(nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target", "left")
    evidence = F.coalesce(F.col("evidence_count"), F.lit(default)).cast("double")
    return own.select("source", "edge_ord", F.log1p(evidence).alias("w"), F.coalesce(graph.hit(F.coalesce("target_name", "target"), skills), F.lit(False)).alias("hit"))


def recommend(nodes: DataFrame, edges: DataFrame, skills: list[str], top_k: int = 5) -> DataFrame:
    """Roles by the share of their weight that the skills cover: occupation, score, hit_count (roles without a hit too)."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    by_role = _weighted(nodes, edges, skills, 0).groupBy("source").agg(F.sum("w").alias("den"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("w"))), F.lit(0.0)).alias("num"), F.count_if("hit").alias("hit_count")).filter("den > 0")
    named = nodes.filter(F.col("entity_type") == "OCC").select(F.col("id").alias("source"), F.col("name").alias("occupation"), "node_ord").join(by_role, "source")
    scored = named.withColumn("score", F.round(F.col("num") / F.col("den"), 6))
    return scored.orderBy(F.desc("score"), F.desc("hit_count"), "node_ord", "source").limit(top_k).select("occupation", "score", "hit_count")


def recommend_ranked(nodes: DataFrame, edges: DataFrame, skills: list[str], top_k: int = 5, roles_only: bool = True) -> DataFrame:
    """The service's ranking: occupation, hit_count, title_hit_count, match_weight, score, best first.

    Roles need a hit; with ``roles_only`` their name must look like an occupation.
    """
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    edges_by_role = _weighted(nodes, edges, skills, 1).groupBy("source").agg(
        F.count_if("hit").alias("hit_count"), F.sum("w").alias("den"), F.sum(F.when(F.col("hit"), F.col("w"))).alias("num"), F.min(F.when(F.col("hit"), F.col("edge_ord"))).alias("first_hit")
    )
    named = edges_by_role.filter("hit_count > 0 and den > 0").join(nodes.filter(F.col("entity_type") == "OCC").select(F.col("id").alias("source"), "name", "alt_names"), "source")
    shown = named.withColumn("occupation", fx.display_name(F.col("name"), F.coalesce("alt_names", F.lit(""))))
    if roles_only:
        shown = shown.filter(fx.looks_like_occupation(F.col("occupation")))
    key = fx.name_key(F.col("occupation"))
    needles = sorted({"".join(s.lower().split()) for s in skills} - {""})
    in_title = sum([F.when(F.contains(key, F.lit(n)), 1).otherwise(0) for n in needles], F.lit(0))
    scored = shown.select("occupation", "hit_count", in_title.alias("title_hit_count"), F.round("num", 6).alias("match_weight"), F.round(F.col("num") / F.col("den"), 6).alias("score"), "first_hit", "source")
    return scored.orderBy(F.desc("hit_count"), F.desc("title_hit_count"), F.desc("match_weight"), F.desc("score"), "first_hit", "source").limit(top_k).drop("first_hit", "source")


def matched_inputs(nodes: DataFrame, edges: DataFrame, skills: list[str]) -> DataFrame:
    """pos, skill, matched for every input, order and repeats kept."""
    spark: SparkSession = nodes.sparkSession
    asked = spark.createDataFrame([(i, s, "".join(s.lower().split())) for i, s in enumerate(skills)], "pos int, skill string, k string")
    known = edges.filter(F.col("relation").isin(*NEEDED)).join(nodes.select(F.col("id").alias("target"), "name"), "target").select(fx.name_key(F.col("name")).alias("k")).distinct().withColumn("matched", F.lit(True))
    return asked.join(known, "k", "left").select("pos", "skill", F.coalesce("matched", F.lit(False)).alias("matched"))


def skill_gap(nodes: DataFrame, edges: DataFrame, occupation: str, skills: list[str], loose: bool = True) -> DataFrame:
    """What an occupation needs beyond ``skills``: skill, essential, evidence_count, proficiency_level, most needed first."""
    own = edges.filter(F.col("relation").isin(*NEEDED)).join(F.broadcast(find_occupation(nodes, occupation, loose).select(F.col("id").alias("source"))), "source")
    named = own.join(nodes.select(F.col("id").alias("target"), "name"), "target", "left").withColumn("skill", F.coalesce("name", "target"))
    missing = named.filter(~graph.hit(F.col("skill"), skills))
    ranked = missing.select("skill", F.coalesce("essential", F.lit(False)).alias("essential"), F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"), "proficiency_level", "edge_ord")
    return ranked.orderBy(F.desc("essential"), F.desc("evidence_count"), "edge_ord").drop("edge_ord")


def growth_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, weighted: bool = True, max_hops: int | None = None, near: float | None = None) -> DataFrame:
    """One row: path (names) and reason.

    With ``near`` the links are not those of ``edges``, but between occupations at least so similar by their skills.

    ``weighted``: directed SIMILAR_TO links, cheap where evidence is high; without any, links between occupations that
    share enough skills.  Otherwise the fewest undirected links, at most ``max_hops`` if given.
    """
    spark = nodes.sparkSession
    loose = not weighted
    a, b = find_occupation(nodes, source, loose).first(), find_occupation(nodes, target, loose).first()

    def answer(path: list[str], reason: str) -> DataFrame:
        return spark.createDataFrame([(path, reason)], "path array<string>, reason string")

    if a is None or b is None:
        return answer([], "occupation_not_found")
    if a.id == b.id:
        return answer([a.name], "same_role" if weighted else "similarity_graph")
    if near is not None:
        edges = graph.similarity_edges(edges, near, [a.id, b.id])
    links = graph.similarity_weights(edges) if weighted else graph.undirected_steps(edges)
    if weighted and links.isEmpty():
        links = graph.dense_fallback(edges)
    found = graph.shortest_paths(links, a.id, b.id, max_hops)
    named = found.select(F.posexplode("path").alias("pos", "id")).join(nodes.select("id", "name"), "id", "left")
    row = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "id").alias("name")))), lambda x: x["name"]).alias("path"))
    reason = F.when(F.size("path") > 0, F.lit("weighted_shortest_path" if weighted else "similarity_graph")).otherwise(F.lit("path_not_found"))
    return row.select("path", reason.alias("reason"))


def payload(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of a visualization: (id, label, name, type) and (source, target, relation, evidence)."""
    return nodes.select("id", "label", "name", F.col("entity_type").alias("type")), edges.select("source", "target", "relation", fx.safe_int(F.col("evidence_count")).alias("evidence"))


def recommend_by_evidence(nodes: DataFrame, edges: DataFrame, skills: list[str], top_k: int = 10) -> DataFrame:
    """The graph-database example: occupation, matched (count of edges), evidence (their sum), most evidence first."""
    named = edges.join(nodes.select(F.col("id").alias("target"), F.col("name").alias("skill")), "target").filter(F.col("skill").isin(*skills))
    named = named.join(nodes.filter(F.col("entity_type") == "OCC").select(F.col("id").alias("source"), F.col("name").alias("occupation")), "source")
    return named.groupBy("source", "occupation").agg(F.count("*").alias("matched"), F.sum("evidence_count").cast("long").alias("evidence")).orderBy(F.desc("evidence"), F.desc("matched"), "occupation", "source").limit(top_k).drop("source")


def top_per_occupation(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` strongest skill edges of every occupation: source, target, evidence_count, rank."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("evidence_count"), "edge_ord"))
    return edges.filter(F.col("relation").isin(*NEEDED)).withColumn("rank", rank).filter(F.col("rank") <= k).select("source", "target", "evidence_count", "rank")

"""The driver's tables as inputs of the graph operators: relation records, labelled sequences, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.operators import fusion, graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation records: suppliers are occupations; part names, brands and types are what they need.  Every line is taken."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    base = lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")
    tails = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("REQUIRES_SKILL").alias("relation"), F.concat(F.lit("p:"), F.col("p_name")).alias("id"), F.col("p_name").alias("text"), F.lit("SKL").alias("kind")),
        F.struct(F.lit(1).alias("k"), F.lit("USES_TOOL").alias("relation"), F.concat(F.lit("b:"), F.col("p_brand")).alias("id"), F.col("p_brand").alias("text"), F.lit("TOL").alias("kind")),
        F.struct(F.lit(2).alias("k"), F.lit("REQUIRES_KNOWLEDGE").alias("relation"), F.concat(F.lit("t:"), F.col("p_type")).alias("id"), F.col("p_type").alias("text"), F.lit("KNW").alias("kind")),
    )
    level = F.get(F.array(*[F.lit(x) for x in ("expert", "proficient", "familiar", "basic", None)]), (F.col("l_linenumber") % 5).cast("int"))
    return base.select("*", F.explode(tails).alias("t")).select(
        F.concat(F.lit("s:"), F.col("l_suppkey")).alias("head_id"),
        F.concat("s_name", F.lit(" engineer")).alias("head_text"),
        F.lit("OCC").alias("head_type"),
        "t.relation",
        F.col("t.id").alias("tail_id"),
        F.col("t.text").alias("tail_text"),
        F.col("t.kind").alias("tail_type"),
        (F.col("l_returnflag") == "R").alias("essential"),
        F.lit(1).cast("long").alias("evidence_count"),
        level.alias("proficiency_level"),
        F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_discount") * 100)).alias("experience_years"),
        F.col("l_orderkey").cast("string").alias("sentence_id"),
        ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 3 + F.col("t.k")).alias("ord"),
        F.lit("distant").alias("head_source"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("ESCO")).otherwise(F.lit("O*NET")).alias("tail_source"),
    )


RECORDS_SQL = """
rec AS (
  SELECT 's:' || l_suppkey AS head_id, s_name || ' engineer' AS head_text, 'OCC' AS head_type, t.relation, t.id AS tail_id, t.txt AS tail_text, t.kind AS tail_type,
         l_returnflag = 'R' AS essential,
         CASE l_linenumber % 5 WHEN 0 THEN 'expert' WHEN 1 THEN 'proficient' WHEN 2 THEN 'familiar' WHEN 3 THEN 'basic' END AS proficiency_level,
         CASE l_linenumber % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS lvl,
         CASE WHEN l_linenumber % 2 = 0 THEN round(l_discount * 100) END AS experience_years,
         CAST(l_orderkey AS VARCHAR) AS sentence_id, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 3 + t.k AS ord,
         CASE WHEN l_linenumber % 2 = 0 THEN 'ESCO' ELSE 'O*NET' END AS tail_source
  FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey,
  LATERAL (SELECT 0 AS k, 'REQUIRES_SKILL' AS relation, 'p:' || p_name AS id, p_name AS txt, 'SKL' AS kind
           UNION ALL SELECT 1, 'USES_TOOL', 'b:' || p_brand, p_brand, 'TOL'
           UNION ALL SELECT 2, 'REQUIRES_KNOWLEDGE', 't:' || p_type, p_type, 'KNW') t),
edg AS (
  SELECT head_id AS source, tail_id AS target, relation, bool_or(essential) AS essential, count(*) AS evidence_count,
         arg_max(proficiency_level, lvl * 10000000000000000 - ord) AS proficiency_level, max(experience_years) AS experience_years, min(ord) AS edge_ord
  FROM rec GROUP BY ALL),
nod AS (
  SELECT id, arg_min(kind, ord) AS entity_type, arg_min(txt, ord) AS name, min(ord) AS node_ord, count(DISTINCT txt) AS n_names
  FROM (SELECT head_id AS id, head_text AS txt, head_type AS kind, ord * 2 AS ord FROM rec UNION ALL SELECT tail_id, tail_text, tail_type, ord * 2 + 1 FROM rec) GROUP BY id),
skl AS (SELECT DISTINCT source AS occ, target AS skill FROM edg),
jac AS (
  SELECT a, b, c::DOUBLE / (n1.n + n2.n - c) AS jaccard
  FROM (SELECT x.occ AS a, y.occ AS b, count(*) AS c FROM skl x JOIN skl y ON x.skill = y.skill AND x.occ < y.occ GROUP BY ALL)
  JOIN (SELECT occ, count(*) AS n FROM skl GROUP BY occ) n1 ON n1.occ = a JOIN (SELECT occ, count(*) AS n FROM skl GROUP BY occ) n2 ON n2.occ = b)"""


#: Values at which a role of ``event_records`` ends and the next one begins.
MAGNITUDES = (1, 3, 7, 15, 31, 63, 127, 255)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation records with few skills a role, so that skill sets differ: every event is taken.

    A role is a user at one magnitude of value, a skill is a type of event with a tenth of the values of ``k``.
    """
    e = table(spark, sf_dir, "events")
    size = sum((F.when(F.col("value") >= m, 1).otherwise(0) for m in MAGNITUDES), F.lit(0))
    k = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 10).cast("bigint")
    return e.select(
        F.concat_ws("-", F.concat(F.lit("u:"), F.col("user_id")), size).alias("head_id"),
        F.concat_ws(" ", F.lit("User"), "user_id", F.lit("level"), size).alias("head_text"),
        F.lit("OCC").alias("head_type"),
        F.lit("REQUIRES_SKILL").alias("relation"),
        F.concat_ws("-", F.lit("k"), "event_type", k).alias("tail_id"),
        F.concat_ws(" ", "event_type", k).alias("tail_text"),
        F.lit("SKL").alias("tail_type"),
        (F.col("value") >= 50).alias("essential"),
        F.lit(1).cast("long").alias("evidence_count"),
        F.when(F.col("value") >= 100, F.lit("expert")).alias("proficiency_level"),
        F.lit(None).cast("double").alias("experience_years"),
        F.col("event_id").cast("string").alias("sentence_id"),
        F.col("event_id").alias("ord"),
        F.lit("distant").alias("head_source"),
        F.lit("ESCO").alias("tail_source"),
    )


_SIZE = " + ".join(f"(value >= {m})::INTEGER" for m in MAGNITUDES)
_RECORD_CTES = RECORDS_SQL[RECORDS_SQL.index("skl AS (") :]
EVENT_SQL = f"""
rec AS (
  SELECT 'u:' || user_id || '-' || ({_SIZE}) AS head_id, 'User ' || user_id || ' level ' || ({_SIZE}) AS head_text, 'OCC' AS head_type, 'k-' || event_type || '-' || k AS tail_id, event_type || ' ' || k AS tail_text, 'SKL' AS tail_type, event_id AS ord
  FROM (SELECT *, (props ->> '$.k')::BIGINT // 10 AS k FROM events)),
edg AS (SELECT head_id AS source, tail_id AS target, 'REQUIRES_SKILL' AS relation, count(*) AS evidence_count, min(ord) AS edge_ord FROM rec GROUP BY ALL),
nod AS (
  SELECT id, arg_min(kind, ord) AS entity_type, arg_min(txt, ord) AS name, min(ord) AS node_ord
  FROM (SELECT head_id AS id, head_text AS txt, head_type AS kind, ord * 2 AS ord FROM rec UNION ALL SELECT tail_id, tail_text, tail_type, ord * 2 + 1 FROM rec) GROUP BY id),
{_RECORD_CTES}"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_from(fusion.fuse_relations(event_records(spark, sf_dir)))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_from(fusion.fuse_nodes(event_records(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_from(fusion.fuse_relations(records(spark, sf_dir)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_from(fusion.fuse_nodes(records(spark, sf_dir)))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sequences: the lines of an order are tokens, flags are B, I and O, suppliers give entity types.

    id, text, tokens, labels; ``other`` is a second labelling of the same tokens.
    """
    lines = table(spark, sf_dir, "lineitem")
    kind = F.get(F.array(*[F.lit(x) for x in ("OCC", "SKL", "TOL", "KNW")]), (F.col("l_suppkey") % 4).cast("int"))
    mark = F.when(F.col("l_returnflag") == "A", F.lit("B-")).when(F.col("l_returnflag") == "R", F.lit("I-"))
    label = F.coalesce(F.concat(mark, kind), F.lit("O"))
    other = F.when(F.col("l_linestatus") == "O", label).otherwise(F.lit("O"))
    token = F.concat(F.lit("w"), F.col("l_partkey"))
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", token.alias("token"), label.alias("label"), other.alias("other")))).alias("r"))
    return rows.select("id", F.col("r.token").alias("tokens"), F.col("r.label").alias("labels"), F.col("r.other").alias("other")).withColumn("text", F.array_join("tokens", " ")).withColumn("lang", F.lit("en")).withColumn("ord", F.col("id"))


TAGGED_SQL = """
raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, 'w' || l_partkey AS token, CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'R' THEN 'I' ELSE 'O' END AS mark,
         CASE l_suppkey % 4 WHEN 0 THEN 'OCC' WHEN 1 THEN 'SKL' WHEN 2 THEN 'TOL' ELSE 'KNW' END AS kind, l_linestatus AS st
  FROM lineitem),
tok AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE mark WHEN 'O' THEN 'O' ELSE mark || '-' || kind END, CASE WHEN mark = 'O' OR st <> 'O' THEN 'O' ELSE mark || '-' || kind END) - 1 AS pos,
         token, mark, kind, st
  FROM raw),
off AS (SELECT *, (sum(length(token) + 1) OVER (PARTITION BY id ORDER BY pos) - length(token) - 1)::BIGINT AS start_char FROM tok),
op AS (
  SELECT *, CASE WHEN mark = 'B' OR (mark = 'I' AND (lag(mark) OVER w IS NULL OR lag(mark) OVER w = 'O' OR lag(kind) OVER w <> kind)) THEN 1 ELSE 0 END AS opens
  FROM off WINDOW w AS (PARTITION BY id ORDER BY pos)),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS isl FROM op WHERE mark <> 'O'),
spn AS (
  SELECT id, isl, min(kind) AS entity_type, min(pos) AS start_token, max(pos) AS end_token, min(start_char) AS start_char, max(start_char + length(token)) AS end_char,
         string_agg(token, ' ' ORDER BY pos) AS txt
  FROM isl GROUP BY id, isl)"""


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary with repeated terms: parts, their brand and type as other names."""
    p = table(spark, sf_dir, "part")
    kind = F.get(F.array(*[F.lit(x) for x in ("SKL", "TOL", "KNW")]), (F.col("p_partkey") % 3).cast("int"))
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("p:"), F.col("p_partkey")).alias("canonical_id"),
        kind.alias("entity_type"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term"),
        F.col("p_brand").alias("source"),
        F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.col("p_type")).alias("description"),
        F.array("p_brand", "p_type").alias("aliases"),
    )


PART_ENTRIES_SQL = """
ent AS (
  SELECT p_partkey AS ord, 'p:' || p_partkey AS canonical_id, CASE p_partkey % 3 WHEN 0 THEN 'SKL' WHEN 1 THEN 'TOL' ELSE 'KNW' END AS entity_type,
         CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS term, p_brand AS source, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS description, p_brand, p_type
  FROM part)"""


def benchmark_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary for text: the first one to three words of the benchmark's items."""
    words = F.split(F.btrim(F.regexp_replace("text", r"[^\p{L} ]+", " ")), " +")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (1, 2, 3)])).alias("k", "term"))
    kind = F.get(F.array(*[F.lit(x) for x in ("SKL", "TOL", "KNW")]), (F.col("item_id") % 3).cast("int"))
    return rows.filter(F.length("term") >= 3).select((F.col("item_id") * 3 + F.col("k")).alias("ord"), F.concat_ws(":", F.lit("q"), "item_id", "k").alias("canonical_id"), kind.alias("entity_type"), "term", F.lit("ESCO").alias("source"), F.lit("").alias("description"), F.array(F.lower("term")).alias("aliases"))


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short requirement texts with levels, hints and years: id, text."""
    levels = F.array(*[F.lit(x) for x in ("Expert in", "experienced with", "familiar:", "basic", "Advanced", "精通", "knows")])
    hints = F.array(*[F.lit(x) for x in ("", " preferred", " nice to have", " surplus", " 优先")])
    years = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit(" "), F.col("l_tax") * 100 + 1, F.lit(" years"))).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit(" "), F.col("l_linenumber"), F.lit("年"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.get(levels, (F.col("l_partkey") % 7).cast("int")), F.lit(" w"), F.col("l_partkey"), F.get(hints, (F.col("l_orderkey") % 5).cast("int")), F.regexp_replace(years, "[.]0 ", " ")).alias("text"),
    )

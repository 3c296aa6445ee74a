"""Composite pipelines: vocabulary, weak labels, gold sample, full input, graph build, training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import text as fx
from skillweave.operators import align, bio, evaluation, fusion, gazetteer, graph
from skillweave.session import materialise
from skillweave.sources import readers, sinks


def build_gazetteer(spark: SparkSession, esco: str | None = None, onet: str | None = None) -> DataFrame:
    """The merged vocabulary of an ESCO and an O*NET table; ESCO rows come first."""
    parts = []
    if esco:
        parts.append(readers.read_esco(spark, esco).withColumn("part", F.lit(0)))
    if onet:
        parts.append(readers.read_onet(spark, onet).withColumn("part", F.lit(1)))
    if not parts:
        raise ValueError("no vocabulary given")
    every = reduce(DataFrame.unionByName, parts)
    return gazetteer.merge(every.withColumn("ord", F.struct("part", "ord")))


def _ordered(entries: DataFrame) -> DataFrame:
    """Entries with ``ord`` as a number, in table order where they have none."""
    if "ord" in entries.columns:
        return entries
    return entries.withColumn("ord", F.monotonically_increasing_id())


def weak_label(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """One labelled example per sentence of title and description: id ``posting#sentence``, tokens, labels, mentions."""
    text = F.concat_ws(". ", F.nullif("title", F.lit("")), "description")
    rows = postings.select("ord", F.col("id").alias("posting"), "lang", F.posexplode(fx.sentences(text)).alias("sent_ord", "text"))
    named = rows.select((F.col("ord").cast("decimal(38,0)") * F.lit(1 << 31) + F.col("sent_ord")).cast("decimal(38,0)").alias("ord"), F.concat_ws("#", "posting", "sent_ord").alias("id"), "lang", "text")
    return bio.label_examples(gazetteer.char_match(named, _ordered(entries)))


def sample_gold(examples: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    return bio.doccano_rows(bio.gold_sample(examples, n, seed))


def full_input(postings: DataFrame, base: DataFrame, max_sentences: int = 6) -> tuple[DataFrame, DataFrame]:
    """(examples, vocabulary): sentences that name a term, as ``{title} requires {sentence}``, labelled; at most some per posting."""
    titled = postings.withColumn("title", fx.clean_title(F.col("title")))
    vocabulary = gazetteer.enrich(_ordered(base), titled.select("title", "ord")).withColumn("ord", F.monotonically_increasing_id())
    index = gazetteer.term_index(vocabulary)
    rows = titled.select("ord", F.col("id").alias("posting"), "lang", "title", F.posexplode(fx.line_sentences(F.col("description"))).alias("sent_ord", "sentence"))
    keyed = rows.withColumn("id", F.concat_ws("#", "posting", "sent_ord"))
    hits = gazetteer.ngram_match(keyed.select("id", F.col("sentence").alias("text")), index).select("id").distinct()
    rank = F.row_number().over(Window.partitionBy("posting").orderBy("sent_ord"))
    kept = keyed.join(hits, "id", "left_semi").withColumn("n", rank).filter(F.col("n") <= max_sentences)
    texts = kept.select("ord", F.concat(F.col("posting"), F.lit("#full#"), F.col("n") - 1).alias("id"), "lang", "title", F.concat("title", F.lit(" requires "), "sentence").alias("text"))
    texts = texts.withColumn("tokens", fx.tokens(F.col("text"))).withColumn("offsets", fx.token_offsets(F.col("text"), F.col("tokens")))
    found = gazetteer.ngram_match(texts.select("id", "text"), index).groupBy("id").agg(F.collect_list(F.struct("start_token", "n_tokens", "entity_type")).alias("found"))
    joined = texts.join(found, "id", "left")

    def mention(m):
        first, last = F.get("offsets", m["start_token"]), F.get("offsets", m["start_token"] + m["n_tokens"] - 1)
        return F.struct(first["start"].alias("start"), last["end"].alias("end"), m["entity_type"].alias("entity_type"))

    occupation = F.array(F.struct(F.lit(0).alias("start"), F.length("title").alias("end"), F.lit("OCC").alias("entity_type")))
    mentions = F.concat(occupation, F.coalesce(F.transform("found", mention), F.array().cast("array<struct<start:int,end:int,entity_type:string>>")))
    labelled = joined.withColumn("mentions", mentions).withColumn("labels", bio.labels_of(F.col("offsets"), F.col("mentions")))
    return labelled.select("ord", "id", "lang", "text", "tokens", "labels"), vocabulary


def build_graph(examples: DataFrame, entries: DataFrame, min_score: float = 85.0, least_similarity: float = 0.3) -> dict[str, DataFrame]:
    """relations, fused, nodes, edges (with derived ones) and a one-row report of labelled examples (ord, id, text, tokens, labels)."""
    ordered = _ordered(entries)
    spans = bio.extract_spans(examples)
    raw = bio.nearest_occupation(spans).join(examples.select("id", F.col("ord").alias("doc_ord")), "id")
    aligned = materialise(align.align_relations(raw, ordered, min_score))  # all that follows reads it
    records = fusion.with_ids(aligned)
    fused, fused_nodes = materialise(fusion.fuse_relations(records)), materialise(fusion.fuse_nodes(records))
    nodes = graph.nodes_from(fused_nodes, ordered)
    base = graph.edges_from(fused)
    similar = graph.similarity_edges(base, least_similarity)
    chain = graph.prerequisite_chain(nodes, base)
    edges = base.unionByName(similar, allowMissingColumns=True).unionByName(chain, allowMissingColumns=True)
    return {"relations": aligned, "fused": fused, "fused_nodes": fused_nodes, "nodes": nodes, "edges": edges, "report": report(aligned, nodes, edges, fused_nodes, fused)}


def report(aligned: DataFrame, nodes: DataFrame, edges: DataFrame, fused_nodes: DataFrame, fused: DataFrame) -> DataFrame:
    heads = aligned.agg(
        F.count("*").alias("total_relations"),
        F.count("head.canonical_id").alias("aligned_heads"),
        F.count("tail.canonical_id").alias("aligned_tails"),
        F.round(F.count("head.canonical_id") / F.nullif(F.count("*"), F.lit(0)), 4).alias("head_coverage"),
        F.round(F.count("tail.canonical_id") / F.nullif(F.count("*"), F.lit(0)), 4).alias("tail_coverage"),
    )
    counts = edges.groupBy("relation").count().agg(F.sum("count").alias("num_edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "count")))).alias("relation_counts"))
    rows = [nodes.agg(F.count("*").alias("num_nodes")), counts, heads, fusion.fusion_stats(fused_nodes, fused)]
    return reduce(lambda x, y: x.join(F.broadcast(y), F.lit(True)), rows)  # one row each


def write_graph_outputs(built: dict[str, DataFrame], path: str) -> None:
    sinks.write_nodes(built["nodes"], f"{path}/nodes")
    sinks.write_edges(built["edges"], f"{path}/edges")
    sinks.write_jsonl(sinks.fused_json(built["fused"], built["fused_nodes"]), f"{path}/fused_relations")


def postings_to_graph(spark: SparkSession, postings: DataFrame, base: DataFrame, path: str, max_sentences: int = 6, min_score: float = 85.0) -> dict[str, DataFrame]:
    """From postings to a graph: labelled examples, vocabulary and graph tables under ``path``, then ``build_graph``'s tables.

    Examples and vocabulary are written first and read back, so that the graph is built from stored tables.
    """
    examples, vocabulary = full_input(postings, base, max_sentences)
    sinks.write_jsonl(examples.select("id", "lang", "text", "tokens", "labels"), f"{path}/examples")
    sinks.write_jsonl(vocabulary.select("canonical_id", "entity_type", "term", "source", "description", "aliases"), f"{path}/gazetteer")
    built = build_graph(readers.read_examples(spark, f"{path}/examples"), readers.read_gazetteer(spark, f"{path}/gazetteer"), min_score)
    write_graph_outputs(built, path)
    return built


def relation_dataset(examples: DataFrame, ratio: int = 1, seed: int = 42) -> DataFrame:
    return evaluation.relation_examples(bio.extract_spans(examples), ratio, seed)


def crf_data(spark: SparkSession, skillspan: str, postings: str, config: dict) -> dict[str, DataFrame]:
    """Converted span examples, and the filtered postings of a configuration (keywords, min_chars, max_rows)."""
    return {"examples": readers.read_skillspan(spark, skillspan), "postings": readers.filter_postings(readers.read_posting_table(spark, postings), config.get("keywords", []), config.get("min_chars", 200), config.get("max_rows", 10_000))}


def train_token_classifier(examples: DataFrame, features: int = 1 << 16):
    """A multinomial logistic regression over hashed token features: a stand-in for a sequence tagger, one token at a time.

    Returns the fitted pipeline; it reads columns ``words`` and writes ``label_text`` predictions.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer

    rows = token_rows(examples)
    indexer = StringIndexer(inputCol="label_text", outputCol="label", handleInvalid="skip").fit(rows)
    stages = [indexer, HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True), LogisticRegression(maxIter=30, regParam=1e-4), IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)]
    return Pipeline(stages=stages).fit(rows)


def token_rows(examples: DataFrame) -> DataFrame:
    """id, pos, label_text, words: features of each token as strings."""
    base = bio.token_features(examples)
    names = ["lower", "isupper", "istitle", "isdigit", "prefix1", "prefix2", "suffix1", "suffix2", "bos", "eos", "prev_lower", "next_lower"]
    words = F.array(*[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    labels = examples.select("id", F.posexplode("labels").alias("pos", "label_text"))
    return base.select("id", "pos", words.alias("words")).join(labels, ["id", "pos"])


def register_views(nodes: DataFrame, edges: DataFrame) -> None:
    """``nodes`` and ``edges`` for plain SQL."""
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")

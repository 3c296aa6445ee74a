"""Sets over few skills meet in blocks: the same pairs, components, paths and ranks as by joins, copies or not."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.operators import blocks, evaluation, graph, vectors

EDGE = "source string, target string, relation string, evidence_count long, edge_ord long"


def _edges(spark, seed, roles=70, skills=12, copies=3):
    """Roles of a few skills each, every one several times under other names."""
    rng = random.Random(seed)
    rows, n = [], 0
    for i in range(roles):
        own = [(t, rng.randint(1, 4)) for t in rng.sample(range(skills), rng.randint(1, 6))]
        for k in range(copies):
            for t, e in own:
                n += 1
                rows.append((f"r{(i * 37 + k * 11) % 97:02d}-{i}-{k}", f"s{t}", "REQUIRES_SKILL", e, rng.randint(0, 40) * 1_000 + n % 1_000))
    return spark.createDataFrame(rows, EDGE).repartition(3).persist()


@pytest.fixture(params=[1])
def edges(spark, request, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_ROWS", 16)
    monkeypatch.setattr(blocks, "AIM", 4)
    monkeypatch.setattr(blocks, "SLICE", 5)
    return _edges(spark, request.param)


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("least", [0.0, 0.4, 0.75])
def test_blocks_find_the_pairs_of_the_join(edges, least):
    classes, _ = graph.skill_classes(graph.skill_pairs(edges))
    got = _rows(graph.similar_classes(classes, least))
    assert got == _rows(graph._prefix_pairs(classes, least)) and got


def test_components_without_the_list_of_links(edges, monkeypatch):
    nodes = edges.select(F.col("source").alias("id")).distinct().unionByName(edges.sparkSession.createDataFrame([("alone",)], "id string"))
    for least in (0.4, 0.8):
        assert _rows(graph.components_by_similarity(nodes, edges, least)) == _rows(graph.components(nodes, graph.similarity_edges(edges, least)))
    classes, _ = graph.skill_classes(graph.skill_pairs(edges))
    few, every = graph.linked_classes(classes, 0.3).count(), graph.similar_classes(classes, 0.3).count()
    assert 0 < few < every


def test_paths_over_one_of_each_set(edges):
    ends = sorted(r.source for r in edges.select("source").distinct().collect())
    rng = random.Random(5)
    every = graph.similarity_edges(edges, 0.5).persist()
    for a, b in [rng.sample(ends, 2)]:
        few = graph.similarity_edges(edges, 0.5, [a, b]).persist()
        assert few.count() < every.count() / 4
        for links in (graph.similarity_weights, graph.undirected_steps):
            assert _rows(graph.shortest_paths(links(few), a, b).withColumn("path", F.array_join("path", ">"))) == _rows(graph.shortest_paths(links(every), a, b).withColumn("path", F.array_join("path", ">")))


def _brute_ranks(rows, holdout):
    from math import log1p

    own = {}
    for r in sorted(rows, key=lambda r: r.edge_ord):
        own.setdefault(r.source, []).append((r.target, log1p(r.evidence_count or 0), r.edge_ord))
    den = {o: sum(w for _, w, _ in s) for o, s in own.items()}
    out = []
    for c, s in own.items():
        asked = {t for t, _, _ in s[holdout:]}
        scored = []
        for o, x in own.items():
            if asked & {t for t, _, _ in x} and den[o] > 0:
                scored.append((-round(sum(w for t, w, _ in x if t in asked) / den[o], 6), x[0][2], o))
        at = [o for _, _, o in sorted(scored)]
        if c in at:
            out.append((c, at.index(c) + 1))
    return sorted(out)


@pytest.mark.parametrize("holdout", [1, 2])
def test_ranks_in_blocks(edges, monkeypatch, holdout):
    weightless = edges.sparkSession.createDataFrame([("w1", "s0", "REQUIRES_SKILL", 3, 7), ("w1", "s1", "REQUIRES_SKILL", 0, 8), ("w1", "s2", "REQUIRES_SKILL", 0, 9), ("w2", "s1", "REQUIRES_SKILL", 0, 5), ("w2", "s3", "REQUIRES_SKILL", 2, 6)], EDGE)
    every = edges.unionByName(weightless)
    got = _rows(evaluation.holdout_ranks(every, holdout).select("case", "rank"))
    assert got == _brute_ranks(every.collect(), holdout)
    work = evaluation.holdout_work(every, holdout).first()
    monkeypatch.setattr(blocks, "MOST_ITEMS", 0)
    if holdout == 2:
        assert evaluation.holdout_work(every, holdout).first() == work


def test_nearest_vectors_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    monkeypatch.setattr(vectors, "RUN", 3)
    rng = np.random.default_rng(4)
    points = rng.integers(-2, 3, (150, 5)).astype(float)  # ties and zero vectors among them
    rows = [(i, str(i % 2), p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, grp string, embedding array<double>").repartition(3)
    length = np.linalg.norm(points, axis=1, keepdims=True)
    unit = np.divide(points, length, out=np.zeros_like(points), where=length > 0)
    score = unit @ unit.T * 100
    got = {r.query_id: r for r in vectors.nearest_neighbours(df, df).collect()}
    for i in range(150):
        others = [j for j in range(150) if j != i and j % 2 == i % 2]
        assert got[i].score == pytest.approx(max(score[i, j] for j in others), abs=1e-9) and score[i, got[i].vec_id] == pytest.approx(got[i].score, abs=1e-9)
    ends = spark.createDataFrame([(f"b{k:02d}", "g", [k], bytearray(8)) for k in range(9)], "block string, grp string, ids array<bigint>, points binary")
    every = ends.selectExpr("block AS q").crossJoin(ends.selectExpr("block AS x"))
    met = vectors._met(every, ends, ends)
    sent = met._jdf.queryExecution().optimizedPlan()
    assert met.count() == 9 * 3 and "Sort [tile" in sent.toString()  # 81 pairs, but a row for each query and tile

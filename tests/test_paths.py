"""Paths, components and vector search against plain Python on small inputs; the spread of the event graph."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.operators import graph, vectors
from skillweave.plans import adapters

SF = "/root/testdata/sf0.01"


def _least_paths(links, source, most=None):
    """For each node the least (distance, path) over paths of at most ``most`` links."""
    best, front, k = {source: (0.0, [source])}, {source: (0.0, [source])}, 0
    while front and (most is None or k < most):
        k += 1
        new = {}
        for node, (d, path) in front.items():
            for a, b, w in links:
                if a == node and (b not in best or (d + w, [*path, b]) < best[b]) and (b not in new or (d + w, [*path, b]) < new[b]):
                    new[b] = (d + w, [*path, b])
        best.update(new)
        front = new
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_search_from_both_ends(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(24)]
    links = [(a, b, rng.choice([1.0, 1.0, 2.0, 5.0])) for a in nodes for b in rng.sample(nodes, 2) if a != b]
    df = spark.createDataFrame(links, "source string, target string, weight double").repartition(2).persist()
    for source, target, most in [("n00", "n23", None), ("n05", "n11", None), ("n03", "n03", None), ("n07", "n19", 3), ("n07", "gone", None)]:
        want = _least_paths(links, source, most).get(target)
        got = graph.shortest_paths(df, source, target, most).first()
        assert (None if got is None else (got.distance, got.path)) == want


def test_unweighted_ties_go_to_the_lesser_path(spark):
    rows = [("s", x, 1.0) for x in "abc"] + [(x, y, 1.0) for x in "abc" for y in "def"] + [(y, z, 1.0) for y in "def" for z in "gh"] + [(z, "t", 1.0) for z in "gh"]
    df = spark.createDataFrame(rows, "source string, target string, weight double")
    assert graph.shortest_paths(df, "s", "t").first().path == ["s", "a", "d", "g", "t"]
    assert graph.shortest_paths(df, "s", "t", 3).count() == 0


def test_contraction_finds_components(spark):
    rng = random.Random(3)
    ids = [f"v{i:03d}" for i in range(150)]
    pairs = [(a, b) for a, b in (rng.sample(ids, 2) for _ in range(90))] + [(ids[i], ids[i + 1]) for i in range(100, 140)] + [(ids[0], ids[0])]
    parent = {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(x,) for x in [*ids, "alone"]], "id string")
    edges = spark.createDataFrame([*pairs, ("v001", "unknown")], "source string, target string")
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {**{x: find(x) for x in ids}, "alone": "alone"}
    assert graph.components(nodes.limit(0), edges).count() == 0


def test_event_graph_has_structure(spark):
    """Sets differ, similarities spread from 0 to 1, there are many components and a path of several hops."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    pairs = graph.skill_pairs(adapters.event_edges(spark, SF)).persist()
    classes, members = graph.skill_classes(pairs)
    assert classes.count() > 1_000 and members.count() == 1_188
    spread = graph.similar_sets(pairs, 0.0).agg(F.min("jaccard").alias("low"), F.max("jaccard").alias("high"), F.avg("jaccard").alias("mean")).first()
    assert spread.low < 0.05 and spread.high == 1.0 and spread.mean < 0.3
    assert 200 < graph.similar_components(pairs, 0.4).select("component").distinct().count() < 400


VECTOR = "vec_id bigint, grp string, embedding array<float>"


def _vectors(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims)) * 3
    rows = [(i, "ab"[i % 2], [float(x) for x in np.float32(centres[i % 9] + rng.normal(size=dims))]) for i in range(n)]
    return [*rows, (n, "a", rows[0][2]), (n + 1, "a", rows[0][2]), (n + 2, "c", rows[1][2]), (n + 3, "a", [0.0] * dims), (n + 4, "d", [0.0] * dims), (n + 5, "d", [1.0] * dims)]


def _brute_nearest(rows):
    out = {}
    for i, g, e in rows:
        q = np.array(e) / max(np.linalg.norm(e), 1e-12)
        scored = [(-round(100 * float(q @ np.array(x)) / max(np.linalg.norm(x), 1e-12), 6), j) for j, h, x in rows if h == g and j != i]
        if scored:
            out[i] = (min(scored)[1], -min(scored)[0])
    return out


@pytest.mark.parametrize("block", [16, 1_024])
def test_all_rows_find_their_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = _vectors(4, 400)
    df = spark.createDataFrame([*rows, rows[3], (None, "a", rows[0][2]), (900, None, rows[0][2]), (901, "a", None)], VECTOR).repartition(3)
    got = {r.query_id: (r.vec_id, round(r.score, 6)) for r in vectors.nearest_neighbours(df, df).collect()}
    want = _brute_nearest(rows)
    assert set(got) == set(want) and all(got[i][1] == pytest.approx(want[i][1], abs=2e-6) for i in want)
    assert sum(got[i][0] == want[i][0] for i in want) >= len(want) - 2  # rounding may turn ties
    assert vectors.nearest_neighbours(df.limit(0), df).count() == 0 and vectors.nearest_neighbours(df, df.limit(0)).count() == 0


def test_blocks_are_pruned_and_probes_find_most(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    rows = [r for r in _vectors(5, 700) if any(r[2])]
    df = spark.createDataFrame([(i, "a", e) for i, _, e in rows], VECTOR)
    units = vectors.unit_vectors(df)
    centres = vectors.centres_of(units)
    held = vectors.blocks_of(units, centres)
    pairs = vectors.block_pairs(held, held).collect()
    points = {r.block: np.frombuffer(bytes(r.points), "<f8").reshape(len(r.ids), -1) for r in held.collect()}
    for r in pairs:
        assert (points[r.q] @ points[r.x].T).max() * 100 <= r.bound + 1e-6
    few = {r.query_id: r.vec_id for r in vectors.nearest_neighbours(df, df, probes=6).collect()}
    every = {r.query_id: r.vec_id for r in vectors.nearest_neighbours(df, df).collect()}
    assert sum(few.get(i) == v for i, v in every.items()) >= 0.9 * len(every)

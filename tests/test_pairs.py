"""Pairs of occupations of equal and of similar skill sets: whole, in both directions, written by many tasks."""

import pytest
from pyspark.sql import functions as F

from skillweave.operators import graph

EDGE = "source string, target string, relation string"
#: A large set, one close to it, one far from both, and rows without an occupation.
SETS = {"s:{:02d}": (40, "abcde"), "t:{:02d}": (25, "abcdf"), "u:{:02d}": (3, "az")}


def _edges(spark):
    own = {name.format(i): set(skills) for name, (n, skills) in SETS.items() for i in range(n)}
    rows = [(occ, skill, "REQUIRES_SKILL") for occ, skills in own.items() for skill in skills] + [(None, "a", "REQUIRES_SKILL"), (None, "z", "REQUIRES_SKILL")]
    return own, spark.createDataFrame(rows, EDGE).repartition(3)


def _brute(own, least):
    scores = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a != b}
    return {ab: s for ab, s in scores.items() if s >= least}


@pytest.mark.parametrize("chunk", [4, 512])
def test_every_pair_once_in_both_directions(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk, raising=False)
    own, edges = _edges(spark)
    want = _brute(own, 0.3)
    got = [(r.source, r.target, r.evidence_count, r.relation) for r in graph.similarity_edges(edges, 0.3).collect()]
    assert sorted(got) == sorted((a, b, int(s * 100 + 1e-9), "SIMILAR_TO") for (a, b), s in want.items())
    got = [(r.source, r.target, round(r.weight, 6)) for r in graph.dense_fallback(edges, 0.85).collect()]
    assert sorted(got) == sorted((a, b, round(1 - s + 1e-4, 6)) for (a, b), s in _brute(own, 0.15).items())
    ends = {"s:00", "t:00", "u:00", "s:07", "t:09"}
    got = sorted((r.source, r.target) for r in graph.similarity_edges(edges, 0.3, ["s:07", "t:09"]).collect())
    assert got == sorted(ab for ab in want if set(ab) <= ends)


def test_pairs_of_one_set_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 4, raising=False)
    _, edges = _edges(spark)
    large = edges.filter("source LIKE 's:%'")
    for written in (graph.similarity_edges(large), graph.dense_fallback(large)):
        by_task = [r["count"] for r in written.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by_task) == 40 * 39 and max(by_task) < 40 * 39 / 4

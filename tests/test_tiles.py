"""Blocks meet in tiles: what is found about a row leaves a task once a tile, pairs are written where they are found."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillweave.operators import blocks, evaluation, graph

EDGE = "source string, target string, relation string, evidence_count long, edge_ord long"


@pytest.fixture(scope="module")
def edges(spark):
    """Roles of one to six of 14 skills, some of them equal, some without any neighbour."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        for t in rng.sample(range(14), rng.choice([1, 2, 3, 3, 4, 5, 6])):
            rows.append((f"r{i * 7919 % 1000:03d}", f"s{t:02d}", "REQUIRES_SKILL", rng.choice([1, 1, 1, 2, 3]), i * 100 + len(rows) % 97))
    rows += [(f"lone{k}", f"own{k}", "REQUIRES_SKILL", 1, 90_000 + k) for k in range(3)]
    return spark.createDataFrame(rows, EDGE).repartition(3).persist()


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAST_ROWS", 16), ("AIM", 40)):
        monkeypatch.setattr(blocks, name, value)


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def _sets(edges):
    out = {}
    for r in edges.collect():
        out.setdefault(r.source, set()).add(r.target)
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _tiles(spark, n, fit=None, once=False):
    words = np.arange(8)
    rows = spark.range(n).select("id", (F.col("id") % 5 + 1).alias("n"), F.array(F.col("id") % 8).alias("items"), F.array(F.lit(1.0)).alias("weights"))
    held = blocks.pack(rows, words, ["id"])

    def work(p, q):
        p.found["seen"] = p.found.get("seen", 0) + len(p) * len(q) - (len(p) * (len(p) - 1) // 2 if once and p.number == q.number else 0)
        return iter(())

    def finish(p):
        yield [pa.array([p.number]), pa.array([p.found.get("seen", 0)])]

    return held, blocks.pairs(held, held, words, work, "block long, seen long", fit, finish, once)


@pytest.mark.parametrize("once", [False, True])
def test_a_block_is_sent_once_a_tile(spark, small, once):
    n = 700
    held, found = _tiles(spark, n, once=once)
    sent, every = found.count(), held.count()
    assert found.agg(F.sum("seen")).first()[0] == (n * (n + 1) // 2 if once else n * n)
    assert every >= 35 and sent < every * every / 4  # not once for every block it meets
    assert "matrix" not in held.columns and held.agg(F.max(F.length("places"))).first()[0] <= 2 * 24  # items, not cells


def test_found_pairs_are_not_shuffled(edges, small):
    for written in (graph.similarity_edges(edges, 0.3), graph.dense_fallback(edges, 0.6, 6), graph.similar_sets(graph.skill_pairs(edges), 0.3)):
        plan = written._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    own = _sets(edges)
    want = {(a, b): _jaccard(own[a], own[b]) for a in own for b in own if a != b}
    got = {(r.source, r.target): r.evidence_count for r in graph.similarity_edges(edges, 0.3).collect()}
    assert got == {ab: int(np.floor(s * 100)) for ab, s in want.items() if s >= 0.3}
    got = {(r.source, r.target): r.weight for r in graph.dense_fallback(edges, 0.6, 6).collect()}
    assert got == {ab: pytest.approx(1 - s + 1e-4, abs=6e-7) for ab, s in want.items() if 1 - s <= 0.6}


@pytest.mark.parametrize("weighted", [False, True])
def test_paths_without_the_list_of_links(edges, small, monkeypatch, weighted):
    ends = [("lone0", "r000"), tuple(random.Random(3).sample(sorted(_sets(edges)), 2)), ("r000", "r000")]
    links = (graph.similarity_weights if weighted else graph.undirected_steps)(graph.similarity_edges(edges, 0.6)).persist()
    want = [_rows(graph.shortest_paths(links, a, b).withColumn("path", F.array_join("path", ">"))) for a, b in ends]

    def never(*_):
        raise AssertionError("similar pairs are written")

    monkeypatch.setattr(graph, "_pairs_in_blocks", never, raising=False)
    monkeypatch.setattr(graph, "_write_pairs", never)
    got = [_rows(graph.similar_paths(edges, 0.6, a, b, weighted).withColumn("path", F.array_join("path", ">"))) for a, b in ends]
    assert got == want and want[0] == [] and want[1][0][0] > 0


@pytest.mark.parametrize("least", [0.5, 0.75, 1.0])
def test_components_from_few_links(edges, small, monkeypatch, least):
    monkeypatch.setattr(graph, "HUB", 20, raising=False)
    classes, _ = graph.skill_classes(graph.skill_pairs(edges))
    links = graph.linked_classes(classes, least)
    assert links.count() <= 3 * classes.count()
    own, label = _sets(edges), {}
    for x in sorted(own):
        if x not in label:
            label[x], todo = x, [x]
            while todo:
                a = todo.pop()
                for b in own:
                    if b not in label and _jaccard(own[a], own[b]) >= least:
                        label[b] = x
                        todo.append(b)
    assert _rows(graph.similar_components(graph.skill_pairs(edges), least)) == sorted(label.items())


@pytest.mark.parametrize("holdout", [1, 2])
def test_ranks_with_runs_left_out(edges, small, monkeypatch, holdout):
    got = _rows(evaluation.holdout_ranks(edges, holdout).select("case", "rank"))
    work = evaluation.holdout_work(edges, holdout).first()
    monkeypatch.setattr(blocks, "MOST_ITEMS", 0)
    assert got == _rows(evaluation.holdout_ranks(edges, holdout).select("case", "rank")) and len(got) > 100
    assert work == evaluation.holdout_work(edges, holdout).first() and work.sharing > work.scored > 0

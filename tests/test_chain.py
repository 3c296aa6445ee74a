"""The linear chain: dynamic programmes against all paths, gradients against differences, a tagger against a token classifier."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.functions import sequences
from skillweave.operators import crf, evaluation
from skillweave.plans import adapters, pipelines

SF = "/root/testdata/sf0.001"


def _score(e, path, t, first, last):
    return sum(e[i][y] for i, y in enumerate(path)) + sum(t[a][b] for a, b in itertools.pairwise(path)) + first[path[0]] + last[path[-1]]


def _brute(e, t, first, last):
    """Best score, best path (least labels from the end on), log of the sum of exponentials."""
    paths = list(itertools.product(range(len(t)), repeat=len(e)))
    scores = [_score(e, p, t, first, last) for p in paths]
    best = max(scores)
    return best, min((p for p, s in zip(paths, scores, strict=True) if abs(s - best) < 1e-9), key=lambda p: p[::-1]), np.log(np.exp(np.array(scores) - best).sum()) + best


@pytest.mark.parametrize("whole", [True, False])
def test_paths_and_partition_are_those_of_all_paths(spark, whole):
    rng = np.random.default_rng(1)

    def number(*shape):
        return (rng.integers(-3, 4, shape).astype(float) if whole else rng.normal(size=shape)).tolist()

    t, first, last = number(3, 3), number(3), number(3)
    rows = [(k, number(n, 3)) for k, n in enumerate([1, 1, 2, 3, 5, 7, 7, 7, 8])]
    df = spark.createDataFrame([*rows, (100, []), (101, None)], "id int, e array<array<double>>")
    v = sequences.viterbi(F.col("e"), t, first, last)
    got = {r.id: r for r in df.select("id", v.alias("v"), sequences.log_partition(F.col("e"), t, first, last).alias("z"), sequences.path_score(F.col("e"), v["path"], t, first, last).alias("p")).collect()}
    for k, e in rows:
        best, path, z = _brute(e, t, first, last)
        assert got[k].v.score == pytest.approx(best) and got[k].p == pytest.approx(best) and got[k].z == pytest.approx(z)
        assert tuple(got[k].v.path) == path
    assert all(got[k].v.score is None and got[k].v.path == [] and got[k].z is None and got[k].p is None for k in (100, 101))


def test_long_sequences_are_run_through_in_blocks(spark):
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(6_000, 4)), rng.normal(size=(4, 4))
    score, back = e[0], []
    for x in e[1:]:
        ways = score[:, None] + t
        back.append(ways.argmax(0))
        score = ways.max(0) + x
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    df = spark.createDataFrame([(e.tolist(),)], "e array<array<double>>")
    got = df.select(sequences.viterbi(F.col("e"), t.tolist()).alias("v")).first().v
    assert got.path == path[::-1] and got.score == pytest.approx(score.max())


def test_scan_keeps_every_state(spark):
    for n in (0, 1, 255, 256, 257, 1_000):
        run = sequences.scan(F.sequence(F.lit(1), F.col("n")) if n else F.array().cast("array<int>"), F.lit(0), lambda s, x: (s + x, s + x), "int")
        got = spark.createDataFrame([(n,)], "n int").select(run.alias("r")).first().r
        assert got.out == list(itertools.accumulate(range(1, n + 1))) and got.state == n * (n + 1) // 2


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    labels, size = ["O", "B-X", "I-X"], 11
    lengths = np.array([1, 4, 2, 6, 1])
    feats, gold = rng.integers(0, size, (14, 4)), rng.integers(0, 3, 14)
    x = rng.normal(size=crf.n_weights(3, size))

    def loss(v):
        return crf.loss_and_gradient(crf.Model.of(labels, v, size), feats, gold, lengths)[0]

    m = crf.Model.of(labels, x, size)
    total, at = 0.0, 0
    for n in lengths:  # the likelihood itself, over all paths
        e = m.features[feats[at : at + n]].sum(1)
        total += _brute(e, m.transitions, m.first, m.last)[2] - _score(e, gold[at : at + n].tolist(), m.transitions, m.first, m.last)
        at += n
    value, g = crf.loss_and_gradient(m, feats, gold, lengths)
    assert value == pytest.approx(total)
    flat = np.concatenate([g.features.ravel(), g.transitions.ravel(), g.first, g.last])
    for k in range(len(x)):
        step = np.zeros_like(x)
        step[k] = 1e-5
        assert flat[k] == pytest.approx((loss(x + step) - loss(x - step)) / 2e-5, abs=1e-5)


def test_minimise_reaches_known_minima():
    a = np.array([3.0, -0.2, 1.0, -4.0])
    scale = np.array([1.0, 5.0, 0.3, 2.0])
    smooth, _ = crf.minimise(lambda x: (float((scale * (x - a) ** 2).sum()), 2 * scale * (x - a)), np.zeros(4), tolerance=0.0)
    assert np.allclose(smooth, a, atol=1e-4)
    sparse, _ = crf.minimise(lambda x: (float((scale * (x - a) ** 2).sum()), 2 * scale * (x - a)), np.zeros(4), l1=1.0, tolerance=0.0)
    assert np.allclose(sparse, np.sign(a) * np.maximum(np.abs(a) - 1 / (2 * scale), 0), atol=1e-4)


EXAMPLE = "id string, ord long, lang string, text string, tokens array<string>, labels array<string>"


def _ambiguous(seed, n):
    """Every entity begins with one word; how it goes on is said by its label before, the words themselves are the same."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        tokens, labels = [], []
        for _ in range(rng.integers(1, 6)):
            kind = rng.choice(["SKL", "TOL", "O"])
            body = [str(x) for x in rng.choice(["red", "blue", "green"], rng.integers(1, 6))]
            tokens += [{"SKL": "know", "TOL": "use", "O": "see"}[kind], *body, "end"]
            labels += ["O"] + (["O"] * len(body) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(body) - 1)]) + ["O"]
        rows.append((f"s{k}", k, "en", " ".join(tokens), tokens, labels))
    return rows


def _micro(gold, predicted):
    return evaluation.entity_scores(gold.select("id", "labels"), predicted).filter("entity_type = 'micro'").first().f1


def _token_classifier(train, test):
    found = pipelines.train_token_classifier(train).transform(pipelines.token_rows(test))
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "predicted"))), lambda x: x["predicted"]).alias("labels"))


def test_chain_beats_tokens_on_held_out_sentences(spark):
    train, test = (spark.createDataFrame(_ambiguous(*x), EXAMPLE).repartition(3) for x in ((4, 120), (5, 60)))
    model = crf.fit(train, l2=0.01, rounds=40, size=1 << 10)
    chain = _micro(test, crf.tag(test, model))
    assert chain > 0.97 and chain > _micro(test, _token_classifier(train, test)) + 0.05


def test_chain_on_nulls_and_empty_sentences(spark):
    rows = [*_ambiguous(6, 20), ("e", 50, "en", "", [], []), ("n", 51, "en", None, None, None), ("x", 52, "en", "know", ["know", None], ["O", "B-SKL", "O"]), ("y", 53, "en", "a b", ["a", "b"], [None, "B-SKL"])]
    df = spark.createDataFrame(rows, EXAMPLE)
    model = crf.fit(df, rounds=3, size=64)
    got = {r.id: r.labels for r in crf.tag(df, model).collect()}
    assert "e" not in got and "n" not in got and len(got["x"]) == 2 and len(got) == 22
    assert crf.fit(df.limit(0), rounds=2, size=64, labels=["O", "B-SKL"]).features.shape == (64, 2)
    with pytest.raises(ValueError, match="labels beyond"):
        crf.fit(df, rounds=1, size=64, labels=["O"])


def test_chain_on_tagged_orders(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    tagged = adapters.tagged(spark, SF)
    model = crf.fit(tagged, l2=0.01, rounds=10)
    found = crf.tag(tagged, model).withColumnRenamed("labels", "found")
    sizes = tagged.select(F.col("id").cast("string").alias("id"), F.size("tokens").alias("n")).join(found, "id").filter(F.size("found") == F.col("n")).count()
    weights = np.concatenate([model.features.ravel(), model.transitions.ravel(), model.first, model.last])
    encoded = crf.encode(tagged, model.labels, crf.SIZE)
    before, after = (crf.total_gradient(encoded, model.labels, x, crf.SIZE)[0] for x in (np.zeros_like(weights), weights))
    assert sizes == tagged.count() and after + 0.01 * float(weights @ weights) < before  # what training lowers; the labels have no pattern beyond


def test_batches_are_decoded_as_the_expression_does(spark):
    rng = np.random.default_rng(8)
    n = 4
    lengths = np.array([1, 7, 3, 3, 1, 12, 2])
    scores = rng.integers(-2, 3, (lengths.sum(), n)).astype(float)  # many ties
    model = crf.Model([str(i) for i in range(n)], np.zeros((2, n)), rng.integers(-2, 3, (n, n)).astype(float), rng.integers(-2, 3, n).astype(float), rng.integers(-2, 3, n).astype(float))
    upto = np.cumsum(lengths)
    rows = [(k, scores[b - m : b].tolist()) for k, (b, m) in enumerate(zip(upto, lengths))]
    v = sequences.viterbi(F.col("e"), model.transitions.tolist(), model.first.tolist(), model.last.tolist())
    own = [y for r in spark.createDataFrame(rows, "id int, e array<array<double>>").select("id", v["path"].alias("p")).orderBy("id").collect() for y in r.p]
    assert crf.best_paths(model, scores, lengths).tolist() == own


def test_decoding_makes_no_paths_of_expressions(spark):
    model = crf.Model(["O", "B-X"], np.zeros((16, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "id string, tokens array<string>")
    plan = crf.tag(df, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and crf.tag(df, model).collect() == [("a", ["O", "O"])]


@pytest.mark.parametrize("scale", [0.5, 30.0, 2_000.0])
def test_products_give_what_logarithms_give(monkeypatch, scale):
    rng = np.random.default_rng(9)
    lengths = np.array([3, 1, 9, 9, 2])
    feats, gold = rng.integers(0, 13, (24, 5)), rng.integers(0, 4, 24)
    model = crf.Model.of(list("OABC"), rng.normal(size=crf.n_weights(4, 13)) * scale, 13)
    loss, g = crf.loss_and_gradient(model, feats, gold, lengths)
    tried = []
    monkeypatch.setattr(crf, "_scaled", lambda *_: tried.append(1))
    plain, h = crf.loss_and_gradient(model, feats, gold, lengths)
    assert tried and loss == pytest.approx(plain, rel=1e-12)
    for name in ("features", "transitions", "first", "last"):
        np.testing.assert_allclose(getattr(g, name), getattr(h, name), atol=1e-8)

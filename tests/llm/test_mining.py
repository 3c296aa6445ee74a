"""Hard negatives, collocations and MinHash near-dedup against brute force, and the edge cases of their docstrings."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skillweave.llm import collocations, minhash, negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, query string, rank int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _embeddings(spark, rows):
    return spark.createDataFrame([(*r, "q", 1) for r in rows], VECTORS).repartition(3)


def _brute_negatives(rows):
    v = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in e], (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, q, label in v:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p, strict=False)), i, y) for i, p, y in v if i != a))
        for s, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, -t) for t, n, y in scored if y != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, positive, k + 1, n, -s, t) for k, (n, t) in enumerate(fits[:10])]
    return sorted(out)


def _cluster(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(10, dims))
    return [(i, [float(x) for x in centers[i % 10] + 0.4 * rng.normal(size=dims)], i % 10) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1 << 12, 1 << 10, 16), (1 << 19, 40, 64)])
def test_hard_negatives_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("TREE_VALUES", "LEAF"), (sizes[0], sizes[2]), strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = _cluster(1, 600)
    rows += [(1_000, rows[100][1], 3), (1_001, rows[100][1], 0), (1_002, [0.0] * 8, 1), (1_100, rows[5][1], 5), (-100, rows[7][1], 7)]  # ties, zeros, a negative id
    rows += [(1_200, None, 1), (None, rows[1][1], 1), (1_300, rows[1][1], None), (1_003, [float("nan")] * 8, 1), (1_004, [float("inf"), *[0.0] * 7], 2), (1_005, [None, *[0.5] * 7], 2)]
    rows += [(1_006, [3.0, 3.0], 4), (1_007, [], 5)]  # shorter vectors
    got = negatives.hard_negatives(_embeddings(spark, rows), block_values=sizes[1])
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == _brute_negatives(rows)


def test_hard_negatives_of_nothing_and_of_repeated_rows(spark):
    rows = _cluster(2, 210)
    assert negatives.hard_negatives(_embeddings(spark, rows).limit(0)).count() == 0
    assert negatives.hard_negatives(_embeddings(spark, rows[1:100])).count() == 0  # no anchor
    twice = negatives.hard_negatives(_embeddings(spark, [*rows, rows[100], rows[3]])).collect()
    ranks = defaultdict(list)
    for r in twice:
        assert r.positive_id != r.anchor_id and r.negative_id != r.anchor_id
        ranks[r.anchor_id, r.positive_id].append(r.rank)
    assert ranks and all(len(v) <= 20 for v in ranks.values())


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    points = np.floor(256 * np.repeat(rng.normal(size=(20, 16)), 100, axis=0) + 10 * rng.normal(size=(2_000, 16))).astype(np.int64)
    ids, labels = np.arange(2_000), (np.arange(2_000) // 100 % 2).astype(np.int32)
    tree = negatives.Tree(negatives._tree_row(ids, labels, points), 0)
    anchors = points[::97]
    exact = tree.points @ anchors.T
    n = len(anchors)
    queries = negatives.Queries(ids[::97], labels[::97], anchors, np.arange(n), np.full(n, -(1 << 40)), np.full(n, 1 << 40), True, 5)
    for level in tree.levels:
        for node, (a, b) in enumerate(zip(level[0], level[1], strict=True)):
            low, high = negatives._bounds(queries, level, np.arange(n), np.full(n, node))
            assert (low <= exact[a:b].min(0)).all() and (high >= exact[a:b].max(0)).all()
    best = negatives.Best(n, 5)
    assert negatives.search(tree, queries, best) < 0.5 * n * 2_000
    for k in range(n):
        same = [(-int(exact[r, k]), int(tree.ids[r])) for r in range(2_000) if tree.labels[r] == queries.labels[k] and tree.ids[r] != queries.ids[k]]
        assert list(zip((-best.scores[k]).tolist(), best.ids[k].tolist(), strict=True)) == sorted(same)[:5]


def test_products_stay_exact():
    big = np.array([[1 << 30, -(1 << 29), 3]], np.int64)
    assert negatives._products(big, big)[0, 0] == (1 << 60) + (1 << 58) + 9
    huge = np.array([[1 << 31, 5]], np.int64)
    assert negatives._products(huge, np.array([[1 << 31, 1]], np.int64))[0, 0] == (1 << 62) + 5
    with pytest.raises(OverflowError):
        negatives._products(huge, np.array([[1 << 40, 1]], np.int64))


TEXTS = "text string, lang string, phrase string, n bigint"


def _brute_collocations(rows, least, percent=100, best=2_000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^\x20\t]+", piece)
            totals[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def _speech(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gam'ma", "ΔELTA", "é", "x\xa0y", "eta-theta", "42"]
    rows = []
    for _ in range(300):
        parts = [rng.choice(["New York City", "of the  United\tStates of", "in spite", *words]) for _ in range(rng.randint(0, 25))]
        rows.append(("".join(p + rng.choice([" ", "  ", ", ", ". ", "\n", "?!", " "]) for p in parts), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("...", "fr"), ("a " * 3_000, "en"), rows[0], rows[0]]


@pytest.mark.parametrize(("least", "percent", "cells", "at_once"), [(20, 100, None, 400_000), (3, 100, 1 << 16, 700), (20, 60, 1, 50), (300, 100, None, 400_000)])
def test_collocations_brute_force(spark, monkeypatch, least, percent, cells, at_once):
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "MOST_HELD", 200)
    rows = _speech(4)
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], TEXTS).repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, least=least, percent=percent, cells=cells).collect()))
    assert got == _brute_collocations(rows, least, percent)
    first = sorted(map(tuple, collocations.collocations(docs, least=least, percent=percent, best=3).collect()))
    assert first == _brute_collocations(rows, least, percent, 3)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(None, None, "p", 1)], TEXTS)
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0


def test_sketches_never_undercount(spark, monkeypatch):
    """A sketch of one block for many n-grams still lets every frequent one through, and a larger one lets few others."""
    rng = random.Random(5)
    text = [" ".join(f"w{rng.randint(0, 30_000)}" for _ in range(4_000)) + " often seen here" * 8 for _ in range(12)]
    docs = spark.createDataFrame([(t, "en") for t in text], "text string, lang string").repartition(4)
    assert {r.phrase: r.n for r in collocations.frequent_ngrams(docs, least=90).filter("words > 1").collect()}["often seen here"] == 96
    bits = collocations.frequent_cells(docs, 1 << 16, 5, 90)
    assert all(np.unpackbits(b).mean() < 0.01 for b in bits)


def test_scores_pass_64_bits(spark):
    counted = spark.createDataFrame([("en", 0, "", 9 * 10**14), ("en", 1, "a", 10**14), ("en", 1, "b", 3 * 10**14), ("en", 2, "a b", 10**14 - 1)], "lang string, words int, phrase string, n bigint")
    assert collocations.scored(counted).first().score == 1000 * (10**14 - 1) * 9 * 10**14 // (10**14 * 3 * 10**14)


DOC = "doc_id bigint, text string, keys string, n bigint"


def _shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def _brute_components(texts):
    sets, parent = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def _copies(seed):
    """Groups of copies with more and more edits, a group around a text that isn't there, short texts, odd ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for size in [3, 4, 8, 9, 20, 60, 150, 400, 1_500]:
        base = [rng.choice(vocab) for _ in range(size)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40)) if k else 0):
                w[rng.randrange(size)] = f"z{rng.random()}"
            texts.append(" ".join(w))
    base = [rng.choice(vocab) for _ in range(200)]
    for k in range(120):
        w = list(base)
        for _ in range(3 + k % 14):
            w[rng.randrange(200)] = f"y{rng.random()}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return [*texts, texts[0], texts[1].upper(), None, "", " \t\n", "one TWO", "One two", "x " * 5_000, "x " * 4_000, *["same text over and over"] * 60]


@pytest.mark.parametrize("common", [(4, 2_000_000), (2, 50)])
def test_minhash_components(spark, monkeypatch, common):
    monkeypatch.setattr(minhash, "COMMON", common[0])
    monkeypatch.setattr(minhash, "MOST_COMMON", common[1])
    monkeypatch.setattr(minhash, "STAR_CHUNK", 7)
    texts = _copies(6)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], DOC).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_components(texts)


def test_the_rest_is_joined_exactly(spark, monkeypatch):
    """With one band nearly all links are left to the exact join of open members, of which none may be lost."""
    texts = [t for t in _copies(7) if t and len(t) > 100]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    members = spark.createDataFrame([(i, i) for i in range(len(texts))], "doc_id bigint, component bigint")
    sets = [_shingles(t) for t in texts]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(a & b) >= 85 * len(a | b)}
    assert {tuple(sorted((r.a, r.b))) for r in minhash.links_across(members, docs).collect()} == want and len(want) > 500


def test_signatures_estimate_similarity():
    """Densified bins agree with the probability of the sets' similarity, for small sets as for large ones."""
    rng = np.random.default_rng(8)
    for size in (4, 12, 60, 3_000):
        seen = []
        for _ in range(60):
            common, a, b = (np.sort(rng.integers(0, 1 << 64, n, np.uint64)) for n in (size * 3, size, size))
            one, other = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
            seen.append((minhash.signature(one) == minhash.signature(other)).mean())
        assert abs(np.mean(seen) - 0.6) < 0.05


def test_minhash_keeps_one_of_each(spark):
    text = "a b c d e f g h i j"
    rows = [(0, text, "k", 1), (1, text.upper(), "k", 1), (2, "other words here", "k", 1), (3, None, "k", 1), (2, "other words here", "k", 1), (None, text, "k", 1)]
    docs = spark.createDataFrame(rows, DOC)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 2), (False, 3), (True, 0)]
    assert minhash.components(docs.limit(0)).count() == 0

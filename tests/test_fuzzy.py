"""The fuzzy join against all pairs: nothing that reaches the score is lost, and few others are scored."""

import random

import pytest

from skillweave.functions.similarity import indel_ratio_of
from skillweave.operators import align

ENTRY = "ord long, canonical_id string, entity_type string, term string, source string, description string, aliases array<string>"


def _words(seed, n):
    rng = random.Random(seed)
    letters = "abcdeé中 .+"
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30]))) for _ in range(n)]


def _edited(seed, words):
    rng = random.Random(seed)
    out = []
    for w in words:
        cs = list(w)
        for _ in range(rng.randint(0, 3)):
            if cs and rng.random() < 0.5:
                del cs[rng.randrange(len(cs))]
            else:
                cs.insert(rng.randint(0, len(cs)), rng.choice("abxyz"))
        out.append("".join(cs))
    return out


def _data(spark, seed=1):
    words = [*_words(seed, 60), "aaaaaaaaaa", "aaaaaaaa", "abababababab", "babababababa", "Python", "python 3", "PYTHON"]
    entries = [(i, f"e{i}", "SKL" if i % 3 else "TOL", w, "ESCO", "", [w.upper(), words[i // 2]] if i % 5 == 0 else []) for i, w in enumerate(words) if w]
    texts = [*_edited(seed + 1, words), *_edited(seed + 2, words), "", "a", "pyhton"]
    mentions = [("SKL" if i % 2 else "TOL", t) for i, t in enumerate(texts)] + [("SKL", None), ("OCC", "python")]
    return entries, mentions, spark.createDataFrame(entries, ENTRY), spark.createDataFrame(mentions, "entity_type string, text string").repartition(3)


def _brute(entries, mentions, k, least):
    out = {}
    for kind, text in {m for m in mentions if m[1] is not None}:
        scored = []
        for o, cid, t, term, _, _, aliases in entries:
            if t == kind:
                for v, name in enumerate(x for x in [term, *aliases] if x):
                    s = indel_ratio_of(text.lower(), name.lower())
                    if s >= least:
                        scored.append((-s, o, v, cid, name))
        for rank, (s, _, _, cid, name) in enumerate(sorted(scored)[:k], 1):
            out[kind, text, rank] = (cid, name, round(-s, 9))
    return out


@pytest.mark.parametrize("least", [0.0, 30.0, 60.0, 75.0, 80.0, 85.0, 95.0, 100.0])
def test_candidates_are_those_of_all_pairs(spark, least):
    entries, mentions, e, m = _data(spark)
    got = {(r.entity_type, r.text, r["rank"]): (r.canonical_id, r.variant, round(r.score, 9)) for r in align.fuzzy_candidates(m, e, 3, least).collect()}
    assert got == _brute(entries, mentions, 3, least)


def test_few_pairs_are_scored(spark):
    _, _, e, m = _data(spark, 5)
    work = align.fuzzy_work(m, e, 85.0).first()
    found = align.similar_pairs(m.selectExpr("entity_type", "lower(text) AS low").filter("low is not null"), e.selectExpr("entity_type", "lower(term) AS vlow"), 85.0)
    assert 0 < found.count() <= work.scored < work.in_band / 8 and work.scored < 3 * work.mentions


def test_nothing_to_align(spark):
    _, _, e, m = _data(spark)
    assert align.fuzzy_candidates(m.limit(0), e, 3, 85.0).count() == 0 and align.fuzzy_candidates(m, e.limit(0), 3, 85.0).count() == 0
    assert align.fuzzy_work(m.limit(0), e, 85.0).first().scored == 0

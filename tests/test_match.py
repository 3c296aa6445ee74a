"""Dictionary search without word borders against a plain search of every variant in every text."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillweave.operators import gazetteer

ENTRY = "ord long, canonical_id string, entity_type string, term string, source string, description string, aliases array<string>"


def _lower(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if len(text.lower()) != len(text) else text.lower()


def _brute(entries, text):
    if not text:
        return []
    low, candidates, seen = _lower(text), [], set()
    for _, cid, kind, term, _, _, aliases in entries:
        for v in [term, *(aliases or [])]:
            if v and _lower(v) not in seen:
                word = _lower(v)
                seen.add(word)
                at = low.find(word)
                while at >= 0:
                    candidates.append((-len(word), at, at + len(word), kind, cid))
                    at = low.find(word, at + len(word))
    out = []
    for _, start, end, kind, cid in sorted(candidates, key=lambda c: c[:2]):
        if all(end <= s or start >= e for s, e, _, _ in out):
            out.append((start, end, kind, cid))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_mentions_as_plain_search(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(gazetteer, "FILTER_BITS", 64)  # nearly every place passes the filter
    rng = random.Random(seed)
    letters = "aabAB .+cé中İΣς😀"

    def word(n):
        return "".join(rng.choice(letters) for _ in range(n))

    terms = [word(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 70])) for _ in range(60)] + ["aa", "AAA", "C++", "Data Science"]
    entries = [(i, f"e{i}", "SKL" if i % 2 else "TOL", t, "ESCO", "", [terms[i // 2], ""] if i % 4 == 0 else None) for i, t in enumerate(terms)]
    texts = ["", None, "aaaaaaa", "we do data science, C++ and c++", word(3_000)]
    texts += ["".join(rng.choice([word(4), rng.choice(terms), rng.choice(terms).upper()]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = [(f"t{i}", t, i) for i, t in enumerate(texts)] + [("t0", "aaa", 0), ("again", texts[7], 1)]
    found = gazetteer.char_match(spark.createDataFrame(rows, "id string, text string, key int").repartition(3), spark.createDataFrame(entries, ENTRY))
    assert found.columns == ["id", "text", "key", "mentions"]
    got = sorted((r.id, r.key, [tuple(m) for m in r.mentions]) for r in found.collect())
    assert got == sorted((i, k, _brute(entries, t)) for i, t, k in rows)


def test_no_vocabulary_and_no_text(spark):
    rows = spark.createDataFrame([("a", "text")], "id string, text string")
    none = spark.createDataFrame([], ENTRY)
    assert gazetteer.char_match(rows, none).first().mentions == []
    some = spark.createDataFrame([(0, "x", "SKL", "text", "ESCO", "", [])], ENTRY)
    assert gazetteer.char_match(rows.limit(0), some).count() == 0
    assert gazetteer.char_match(rows, some).select(F.size("mentions")).first()[0] == 1


def test_texts_are_hashed_in_bounded_runs(spark, monkeypatch):
    held = []
    plain = gazetteer._seed_hashes
    monkeypatch.setattr(gazetteer, "CHARS_AT_ONCE", 150)
    monkeypatch.setattr(gazetteer, "_seed_hashes", lambda texts, longest: held.append(sum(map(len, texts))) or plain(texts, longest))
    bitmap = np.full(gazetteer.FILTER_BITS // 8, 255, np.uint8)
    texts = ["ab" * (k * 7 % 60) for k in range(40)] + ["", "c" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(len(texts))]), pa.array(texts)], names=["key", "low"])
    places = [(r["key"], r["pos"]) for b in gazetteer._places(SimpleNamespace(value={0: bitmap}))(iter([batch])) for r in b.to_pylist()]
    assert sorted(places) == sorted((f"k{i}", p) for i, t in enumerate(texts) for p in range(len(t)))
    assert sorted(held)[-2] <= 150 and max(held) == 400  # a longer text is a run of its own
    entries = spark.createDataFrame([(0, "x", "SKL", "text", "ESCO", "", [])], ENTRY)
    gazetteer.char_match(spark.createDataFrame([("a", "text")], "id string, text string"), entries)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000


def test_grams_are_made_only_where_a_term_begins(spark):
    rows = [("data science", 2), ("data", 1), ("science of data and more of it", 7), ("big data", 2), ("of data and more of it", 6)]
    entries = spark.createDataFrame([(i, f"e{i}", "SKL", t, "ESCO", "", None) for i, (t, _) in enumerate(rows)], ENTRY)
    index = gazetteer.term_index(entries)
    texts = [("a", "Big data science of Data and more of it"), ("b", "we like big, data"), ("c", ""), ("d", None), ("e", "\x01 data \x01 science"), ("f", "data big")]
    found = gazetteer.ngram_match(spark.createDataFrame(texts, "id string, text string"), index)
    got = sorted((r.id, r.start_token, r.n_tokens, r.canonical_id) for r in found.collect())
    assert got == [("a", 0, 2, "e3"), ("a", 3, 6, "e4"), ("b", 4, 1, "e1"), ("e", 1, 1, "e1"), ("f", 0, 1, "e1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1" not in plan  # no list of all lengths at each token


def test_merged_aliases_keep_their_first_place(spark):
    entries = [(3, "c", "SKL", "A", "s3", "late", ["x", "w", None]), (1, "a", "SKL", "a", "s1", "", ["y", "x", "y"]), (2, "b", "SKL", "a", "s2", "said", None), (4, "d", "SKL", "A", "s4", "", ["z", "y", None]), (5, "e", "TOL", "a", "s5", "", []), (6, "f", "TOL", "b", "s6", None, None)]
    found = gazetteer.merge(spark.createDataFrame(entries, ENTRY).repartition(3))
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])
    assert got == [("a", "SKL", "a", "s1", "said", ["y", "x", "w", None, "z"]), ("e", "TOL", "a", "s5", "", []), ("f", "TOL", "b", "s6", "", [])]
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()

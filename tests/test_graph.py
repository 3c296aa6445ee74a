from pyspark.sql import functions as F

from skillweave.operators import align, bio, evaluation, fusion, gazetteer, graph, queries
from skillweave.plans import pipelines

ENTRIES = [
    (0, "e:ds", "OCC", "Data Scientist", "ESCO", "", ["数据科学家"]),
    (1, "e:ml", "OCC", "ML Engineer", "ESCO", "", []),
    (2, "e:py", "SKL", "Python", "ESCO", "language", ["py"]),
    (3, "o:py", "SKL", "python", "O*NET", "x", ["cpython"]),
    (4, "e:pt", "TOL", "PyTorch", "ESCO", "", []),
]
ENTRY = "ord bigint, canonical_id string, entity_type string, term string, source string, description string, aliases array<string>"
EXAMPLES = [
    (0, "g1", "en", "Data Scientist familiar with Python and PyTorch", "B-OCC I-OCC O O B-SKL O B-TOL"),
    (1, "g2", "en", "ML Engineer expert Python preferred", "B-OCC I-OCC O B-SKL O"),
    (2, "g3", "en", "Pythn only", "B-SKL O"),
    (3, "g4", "en", "Data Scientist Pythons", "B-OCC I-OCC B-SKL"),
]


def _entries(spark):
    return spark.createDataFrame(ENTRIES, ENTRY)


def _examples(spark):
    rows = [(o, i, lang, t, t.split(), labels.split()) for o, i, lang, t, labels in EXAMPLES]
    return spark.createDataFrame(rows, "ord bigint, id string, lang string, text string, tokens array<string>, labels array<string>")


def test_merge_keeps_first(spark):
    got = {r.term: r for r in gazetteer.merge(_entries(spark)).collect()}
    assert len(got) == 4 and got["Python"].canonical_id == "e:py" and got["Python"].aliases == ["py", "cpython"] and got["Python"].description == "language"


def test_spans_follow_rules(spark):
    df = spark.createDataFrame([("a", "x y z w", ["x", "y", "z", "w"], ["I-SKL", "I-TOL", "O", "B-SKL"]), ("b", "q", ["q"], ["O"]), ("c", "", [], [])], "id string, text string, tokens array<string>, labels array<string>")
    got = {r.id: [(s.text, s.entity_type, s.start_char, s.end_char) for s in r.spans] for r in bio.extract_spans(df).collect()}
    assert got == {"a": [("x", "SKL", 0, 1), ("y", "TOL", 2, 3), ("w", "SKL", 6, 7)], "b": [], "c": []}


def test_labels_last_mention_wins(spark):
    df = spark.createDataFrame([("Senior Python Developer", [(0, 23, "OCC"), (7, 13, "SKL")])], "text string, mentions array<struct<start:int,end:int,entity_type:string>>")
    assert bio.label_examples(df).first().labels == ["B-OCC", "B-SKL", "I-OCC"]


def test_char_match_prefers_longest(spark):
    df = spark.createDataFrame([("1", "Our PyTorch python pyx"), ("2", None)], "id string, text string")
    got = {r.id: [(m.start, m.end, m.canonical_id) for m in r.mentions] for r in gazetteer.char_match(df, _entries(spark)).collect()}
    assert got["1"] == [(4, 11, "e:pt"), (12, 18, "e:py"), (19, 21, "e:py")] and got["2"] == []


def test_ngram_match_brute_force(spark):
    rows = [(k, f"c{k}", "SKL", t, "ESCO", "", []) for k, t in enumerate(["big data", "data", "data lake house", "lake"])]
    index = gazetteer.term_index(spark.createDataFrame(rows, ENTRY))
    texts = ["big data lake house", "data lake and big Data", "nothing", "lake data data lake house lake"]
    got = {}
    for r in gazetteer.ngram_match(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string"), index).collect():
        got.setdefault(int(r.id), []).append((r.start_token, r.n_tokens))
    keys = {tuple(t.split()) for t in ("big data", "data", "data lake house", "lake")}
    for i, text in enumerate(texts):
        toks, want, at = text.lower().split(), [], 0
        while at < len(toks):
            n = next((n for n in range(6, 0, -1) if tuple(toks[at : at + n]) in keys and at + n <= len(toks)), 0)
            if n:
                want.append((at, n))
            at += n or 1
        assert sorted(got.get(i, [])) == want


def test_build_graph_golden(spark):
    built = pipelines.build_graph(_examples(spark), gazetteer.merge(_entries(spark)).withColumn("ord", F.monotonically_increasing_id()))
    fused = {(r.head_id, r.relation, r.tail_id): r for r in built["fused"].collect()}
    assert set(fused) == {("e:ds", "REQUIRES_SKILL", "e:py"), ("e:ds", "USES_TOOL", "e:pt"), ("e:ml", "REQUIRES_SKILL", "e:py")}
    one = fused[("e:ds", "REQUIRES_SKILL", "e:py")]
    assert one.evidence_count == 2 and one.proficiency_level == "familiar" and one.sentence_ids == ["g1", "g4"] and one.tail_text == "Python"
    assert fused[("e:ml", "REQUIRES_SKILL", "e:py")].essential is False
    nodes, edges = built["nodes"].cache(), built["edges"].withColumn("edge_ord", F.coalesce("edge_ord", F.lit(10**12))).cache()
    similar = {(r.source, r.target, r.evidence_count) for r in edges.filter("relation = 'SIMILAR_TO'").collect()}
    assert similar == {("e:ds", "e:ml", 50), ("e:ml", "e:ds", 50)}
    assert {r.id: r.name for r in nodes.collect()}["e:ds"] == "Data Scientist"
    report = built["report"].first()
    assert (report.num_nodes, report.total_relations, report.head_coverage, report.tail_coverage) == (4, 4, 1.0, 1.0)
    top = queries.recommend_ranked(nodes, edges, ["python", " Py Torch"], 5).collect()
    assert [(r.occupation, r.hit_count, r.score) for r in top] == [("Data Scientist", 2, 1.0), ("ML Engineer", 1, 1.0)]
    assert [r.skill for r in queries.skill_gap(nodes, edges, "data scientist", ["Python"]).collect()] == ["PyTorch"]
    path = queries.growth_path(nodes, edges, "Data Scientist", "ML Engineer").first()
    assert path.path == ["Data Scientist", "ML Engineer"] and path.reason == "weighted_shortest_path"
    assert queries.growth_path(nodes, edges, "nobody", "ML Engineer").first().reason == "occupation_not_found"
    stats = evaluation.evaluate_graph(nodes, edges).first()
    assert stats.components == 1 and stats.num_edges == 5 and stats.max_degree == 4


def test_fusion_ignores_input_order(spark):
    rows = [("h", "H", "OCC", "R", "t", f"T{k}", "SKL", k == 2, 1, [None, "basic", "expert", "expert"][k], float(k), f"s{k}", k) for k in range(4)]
    ddl = "head_id string, head_text string, head_type string, relation string, tail_id string, tail_text string, tail_type string, essential boolean, evidence_count bigint, proficiency_level string, experience_years double, sentence_id string, ord bigint"
    a = fusion.fuse_relations(spark.createDataFrame(rows, ddl)).first()
    b = fusion.fuse_relations(spark.createDataFrame(rows[::-1], ddl).repartition(3)).first()
    assert a == b and a.tail_text == "T0" and a.proficiency_level == "expert" and a.sentence_ids == ["s0", "s1", "s2", "s3"]


def test_fuzzy_align_threshold(spark):
    mentions = spark.createDataFrame([("SKL", "Pythonn"), ("SKL", "Rust"), ("TOL", "pytorch")], "entity_type string, text string")
    got = {r.text: (r.canonical_id, r.score) for r in align.align(mentions, _entries(spark)).collect()}
    assert got["pytorch"] == ("e:pt", 100.0) and got["Rust"] == (None, None) and got["Pythonn"][0] == "e:py" and round(got["Pythonn"][1], 3) == 92.308


def test_paths_and_components(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0), ("d", "e", 1.0)], "source string, target string, weight double")
    assert graph.shortest_paths(links, "a", "c").first().path == ["a", "b", "c"]
    assert graph.shortest_paths(links, "a", "c", 1).first().distance == 3.0
    assert graph.shortest_paths(links, "c", "a").count() == 0
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    got = {r.id: r.component for r in graph.components(nodes, links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_alignment_keeps_columns_of_the_caller(spark):
    from skillweave.operators import align

    entries = spark.createDataFrame([(0, "c:1", "SKL", "Python", "ESCO", "", ["py"])], "ord bigint, canonical_id string, entity_type string, term string, source string, description string, aliases array<string>")
    mentions = spark.createDataFrame([("SKL", "PYTHON", "mine", "too"), ("SKL", "rust", "mine", "too")], "entity_type string, text string, key string, hit string")
    got = {r.text: (r.key, r.hit, r.canonical_id) for r in align.exact_align(mentions, entries).collect()}
    assert got == {"PYTHON": ("mine", "too", "c:1"), "rust": ("mine", "too", None)}


def test_order_of_large_inputs_fits(spark):
    from skillweave.operators import fusion

    side = "struct<canonical_id:string,entity_type:string,text:string,source:string>"
    row = [("s", (7 << 33) * 10_000, 3, ("a", "OCC", "x", "ESCO"), ("b", "SKL", "y", "ESCO"))]
    got = fusion.with_ids(spark.createDataFrame(row, f"id string, doc_ord bigint, span_ord int, head {side}, tail {side}")).first()
    assert int(got.ord) == (7 << 33) * 10_000 * 100_000 + 3

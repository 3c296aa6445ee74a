"""The keyed store, the written report, the nested relations and the way from postings to answers."""

import json

from skillweave import cli
from skillweave.operators import fusion
from skillweave.sources import readers, sinks

NODE = "id string, name string, entity_type string, source string, node_ord bigint"
EDGE = "source string, relation string, target string, essential boolean, evidence_count bigint, proficiency_level string, experience_years double, edge_ord bigint"


def test_merge_graph_updates_by_key(spark, tmp_path):
    path = str(tmp_path / "store")
    nodes = spark.createDataFrame([("a", "A", "OCC", "ESCO", 0), ("a", "A later", "OCC", None, 5), ("b", "B", "SKL", "ESCO", 1)], NODE)
    edges = spark.createDataFrame([("a", "REQUIRES_SKILL", "b", True, 1, None, None, 0), ("a", "REQUIRES_SKILL", "gone", True, 1, None, None, 1)], EDGE)
    sinks.merge_graph(nodes, edges, path, 0)
    more = spark.createDataFrame([("b", "B2", "TOL", None, 0), ("c", None, "SKL", None, 1)], NODE)
    links = spark.createDataFrame([("a", "REQUIRES_SKILL", "b", False, 7, "expert", 2.0, 0), ("a", "USES_TOOL", "b", None, None, None, None, 1), ("c", "USES_TOOL", "x", True, 1, None, None, 2)], EDGE)
    for _ in range(2):  # again gives the same
        sinks.merge_graph(more, links, path, 1)
        got = {tuple(r) for r in spark.read.parquet(f"{path}/v1/nodes").select("id", "name", "entity_type", "source").collect()}
        assert got == {("a", "A later", "OCC", None), ("b", "B2", "TOL", None), ("c", None, "SKL", None)}
        kept = {(r.source, r.relation, r.target): (r.essential, r.evidence_count, r.proficiency_level, r.experience_years) for r in spark.read.parquet(f"{path}/v1/edges").collect()}
        assert kept == {("a", "REQUIRES_SKILL", "b"): (False, 7, "expert", 2.0), ("a", "USES_TOOL", "b"): (None, None, None, None)}
    sinks.merge_graph(more.limit(0), links.limit(0), path, 2)
    assert spark.read.parquet(f"{path}/v2/nodes").count() == 3 and spark.read.parquet(f"{path}/v2/edges").count() == 2


def test_experiment_report():
    score = {"f1": 0.5, "precision": 0.25, "recall": 0.75}
    text = sinks.experiment_markdown({"train": 3, "dev": 2, "test": 1}, {"docs": 4, "docs_with_hits": 2, "ratio": 0.5}, {"base": {"dev": score, "test": score}, "gazetteer": {"dev": score, "test": score | {"f1": 0.75}}})
    lines = text.splitlines()
    assert lines[0] == "# CRF Formal Experiment Report" and "- Train examples: 3" in lines and "- Coverage ratio: 0.5" in lines
    assert "### gazetteer" in lines and lines.count("- Test Precision: 0.25") == 2 and lines[-1] == "- Delta F1: 0.25"


def test_fused_json_has_offsets_and_names(spark):
    side = "struct<text string, entity_type string, start_char int, canonical_id string, source string, score double>"
    rows = [("d", 0, 0, ("Dev", "OCC", 0, "e:1", "O*NET", 100.0), ("py", "SKL", 4, "e:2", "ESCO", 90.0)), ("d", 1, 0, ("Coder", "OCC", 9, "e:1", "ESCO", 88.0), ("py", "SKL", 1, "e:2", "ESCO", 90.0))]
    given = spark.createDataFrame([(*r, "REQUIRES_SKILL", True, 1, None, None) for r in rows], f"id string, doc_ord bigint, span_ord int, head {side}, tail {side}, relation string, essential boolean, evidence_count bigint, proficiency_level string, experience_years double")
    records = fusion.with_ids(given)
    got = sinks.fused_json(fusion.fuse_relations(records), fusion.fuse_nodes(records)).collect()
    assert len(got) == 1
    head = got[0].head.asDict()
    assert head == {"text": "Dev", "type": "OCC", "start_char": 0, "canonical_id": "e:1", "score": 100.0, "source": "ESCO", "alt_names": ["Coder", "Dev"]}
    assert got[0].tail.alt_names == ["py"] and got[0].attributes.evidence_count == 2


def test_postings_to_answers(spark, tmp_path, capsys):
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "p1", "lang": "en", "title": "Data Engineer", "description": "You know Python and Docker well."}) + "\n" + json.dumps({"id": "p2", "lang": "en", "title": "Cook", "description": "Nothing here."}) + "\n")
    terms = [{"canonical_id": f"e:{t}", "entity_type": k, "term": t, "source": "ESCO", "description": "", "aliases": []} for t, k in (("Python", "SKL"), ("Docker", "TOL"))]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(t) for t in terms) + "\n")
    out = str(tmp_path / "out")
    cli.run(spark, cli.parser().parse_args(["postings-to-answers", "--postings", str(tmp_path / "p.jsonl"), "--gazetteer", str(tmp_path / "g.jsonl"), "--skills", "python", "--output", out]))
    answers = json.loads(capsys.readouterr().out)
    assert [(r["occupation"], r["hit_count"]) for r in answers] == [("Data Engineer", 1)]
    assert readers.read_edges(spark, f"{out}/edges").count() >= 2 and json.load(open(f"{out}/report.json"))["num_nodes"] >= 3


RECORD = "head_id string, head_text string, head_type string, relation string, tail_id string, tail_text string, tail_type string, essential boolean, evidence_count bigint, proficiency_level string, experience_years double, sentence_id string, ord bigint"


def test_upsert_keeps_sentences_apart(spark, tmp_path):
    from skillweave.streaming import postings

    path = str(tmp_path / "fused")
    write = postings.upsert_fused(path)
    for batch, ids in enumerate([["a", "b"], ["c"], ["d"]]):
        rows = [("h", "H", "OCC", "REQUIRES_SKILL", "t", "T", "SKL", None, None if i == "c" else 2, "basic", None, i, batch * 10 + k) for k, i in enumerate(ids)]
        for _ in range(2):  # a batch that runs again
            write(spark.createDataFrame(rows, RECORD), batch)
    got = spark.read.parquet(f"{path}/v2").first()
    assert got.sentence_ids == ["a", "b", "c", "d"] and got.evidence_count == 7 and got.essential is True


def test_fusion_counts_unsaid_evidence_and_essential(spark):
    base = ("h", "H", "OCC", "R", "t", "T", "SKL")
    rows = [(*base, False, 0, None, None, "x", 0), (*base, None, None, "expert", 3.0, None, 1)]
    got = fusion.fuse_relations(spark.createDataFrame(rows, RECORD)).first()
    assert got.evidence_count == 2 and got.essential is True and got.proficiency_level == "expert" and got.sentence_ids == ["x", None]


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    """The bucketed store gives what the merged one gives, and a change of a few keys writes few files."""
    one, other = str(tmp_path / "merged"), str(tmp_path / "bucketed")
    nodes = [(f"n{i}", f"N{i}", "OCC" if i % 2 else "SKL", "ESCO", i) for i in range(600)]
    edges = [(f"n{i}", "REQUIRES_SKILL", f"n{(i * 7) % 610}", True, i, None, None, i) for i in range(1, 600, 2)]
    more = [("n3", "N3 later", "OCC", None, 0), ("new", "New", "SKL", "O*NET", 1)]
    links = [("n3", "REQUIRES_SKILL", "n21", False, 9, "expert", 2.0, 0), ("n3", "USES_TOOL", "new", None, None, None, None, 1), ("n3", "USES_TOOL", "nowhere", None, None, None, None, 2)]

    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "bucketed").rglob("*.parquet") if "manifest" not in str(f)}

    for version, (n, e) in enumerate([(nodes, edges), (more, links), ([], [])]):
        before = files() if version else {}
        given = spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)
        for _ in range(2 if version == 1 else 1):
            sinks.upsert_graph(*given, other, version)
        sinks.merge_graph(*given, one, version)
        held = sinks.stored_graph(spark, other, version)
        for name, df in zip(("nodes", "edges"), held, strict=True):
            want = spark.read.parquet(f"{one}/v{version}/{name}")
            columns = sorted(want.columns)
            assert sorted(map(repr, df.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
        if version:
            assert before.items() <= files().items() and len(set(files()) - set(before)) <= (4 if version == 1 else 0)
    assert sinks.stored_graph(spark, other, 0)[0].filter("id = 'new'").count() == 0


def test_archive_is_parsed_in_pieces(spark, tmp_path):
    import zipfile

    rows = [f"c{i}\tSkill {i}\t\"a {i}\nsecond line\"" for i in range(300)]
    with zipfile.ZipFile(tmp_path / "db.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("db/Skills.txt", "Element ID\tElement Name\tDescription\n" + "\n".join(rows) + "\n")
        z.writestr("db/Tools Used.txt", "Commodity Code\tCommodity Title\n7\tHammer\n8\t\n")
        z.writestr("db/Readme.md", "nothing")
    whole = readers.read_onet_zip(spark, str(tmp_path / "db.zip")).orderBy("ord")
    pieces = readers.read_onet_zip(spark, str(tmp_path / "db.zip"), 200)
    assert pieces.rdd.glom().map(len).filter(lambda n: n > 0).count() > 1
    for df in (whole, pieces.orderBy("ord")):
        got = [(r.canonical_id, r.entity_type, r.term, r.description) for r in df.collect()]
        assert got == [(f"c{i}", "SKL", f"Skill {i}", f"a {i}\nsecond line") for i in range(300)] + [("7", "TOL", "Hammer", "")]

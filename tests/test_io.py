import json
import zipfile

from pyspark.sql import functions as F

from skillweave import cli
from skillweave.plans import pipelines
from skillweave.sources import readers, sinks
from skillweave.streaming import postings

ESCO = "uri,preferredLabel,altLabels,entityType,description\ne:py,Python,py|蟒蛇,SKL,language\ne:dev,Developer,,OCC,\n"
ONET = "category\tcode\tlabel\taliases\tdescription\nSKL\t1\tpython\tcpython\tother\nTOL\t2\tDocker\t\t\n"


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text(ESCO)
    (tmp_path / "o.tsv").write_text(ONET)
    got = {r.term: r for r in pipelines.build_gazetteer(spark, str(tmp_path / "e.csv"), str(tmp_path / "o.tsv")).collect()}
    assert set(got) == {"Python", "Developer", "Docker"} and got["Python"].aliases == ["py", "蟒蛇", "cpython"] and got["Docker"].canonical_id == "onet:TOL:2"


def test_zip_and_official(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "db.zip", "w") as z:
        z.writestr("db/Skills.txt", "O*NET-SOC Code\tElement Name\n11-1\tReading\n11-2\t\n")
        z.writestr("db/Readme.txt", "x")
    got = readers.read_onet_zip(spark, str(tmp_path / "db.zip")).collect()
    assert [(r.canonical_id, r.entity_type, r.term) for r in got] == [("11-1", "SKL", "Reading")]
    (tmp_path / "official.csv").write_text("conceptType,conceptUri,preferredLabel,altLabels\nOccupation,u1,Cook,chef;chef\n,,Knife,\n")
    rows = {r.term: r for r in readers.read_esco_official(spark, str(tmp_path / "official.csv")).collect()}
    assert rows["Cook"].entity_type == "OCC" and rows["Cook"].aliases == ["chef", "chef"] and rows["Knife"].canonical_id == "Knife"


def test_graph_csv_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "OCC", "A", "OCC", "ESCO", "A|B", 0), ("a", "OCC", "A2", "OCC", "ESCO", "", 1), ("b", "SKL", 'x "q"', "SKL", None, "", 2)], "id string, label string, name string, entity_type string, source string, alt_names string, node_ord bigint")
    edges = spark.createDataFrame([("a", "b", "REQUIRES_SKILL", True, 3, None, 1.5), ("a", "b", "USES_TOOL", False, None, "basic", None)], "source string, target string, relation string, essential boolean, evidence_count bigint, proficiency_level string, experience_years double")
    sinks.write_nodes(nodes.coalesce(1), str(tmp_path / "n"))
    sinks.write_edges(edges, str(tmp_path / "e"))
    got = {r.id: r.name for r in readers.read_nodes(spark, str(tmp_path / "n")).collect()}
    assert got == {"a": "A2", "b": 'x "q"'}
    back = {r.relation: r for r in readers.read_edges(spark, str(tmp_path / "e")).collect()}
    assert back["REQUIRES_SKILL"].essential and back["REQUIRES_SKILL"].experience_years == 1.5 and back["USES_TOOL"].evidence_count is None and back["USES_TOOL"].essential is False


def test_weak_label_and_full_input(spark, tmp_path):
    rows = [{"id": "p1", "lang": "en", "title": "3. Developer", "description": "Knows Python well. Likes tea.\nDocker and Python needed."}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "e.csv").write_text(ESCO)
    jobs = readers.read_postings(spark, str(tmp_path / "p.jsonl"))
    entries = pipelines.build_gazetteer(spark, str(tmp_path / "e.csv"))
    labelled = pipelines.weak_label(jobs, entries).collect()
    assert all(len(r.tokens) == len(r.labels) for r in labelled) and any("B-SKL" in r.labels for r in labelled)
    examples, vocabulary = pipelines.full_input(jobs, entries, 6)
    got = sorted((r.id, r.text, r.labels) for r in examples.collect())
    assert [x[0] for x in got] == ["p1#full#0", "p1#full#1"] and got[1][1] == "Developer requires Docker and Python needed."
    assert got[1][2] == ["B-OCC", "O", "B-TOL", "O", "B-SKL", "O"]
    assert vocabulary.filter("source = 'curated'").count() > 30


def test_stream_and_cli(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"id": "1", "lang": "en", "title": "t", "description": "Expert in Go. 3 years plus"}) + "\n")
    q = postings.sentence_stream(postings.posting_stream(spark, str(src))).writeStream.format("memory").queryName("sents").start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: (r.proficiency_level, r.essential, r.experience_years) for r in spark.table("sents").collect()}
    assert got == {"1#0": ("expert", True, None), "1#1": (None, False, 3.0)}
    (tmp_path / "e.csv").write_text(ESCO)
    args = cli.parser().parse_args(["build-gazetteer", "--esco", str(tmp_path / "e.csv"), "--output", str(tmp_path / "g")])
    cli.run(spark, args)
    assert readers.read_gazetteer(spark, str(tmp_path / "g")).select(F.count("*")).first()[0] == 2

"""Queries over whole tables hold every row of them."""

import os
import re

import pytest
from pyspark.sql import functions as F

from skillweave import registry
from skillweave.operators import gazetteer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_whole_graph_has_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    edges = registry.queries()["build_edges"](spark, SF)
    assert edges.agg(F.sum("evidence_count")).first()[0] == 3 * lines


def test_line_sentences_are_all_there(spark):
    got = registry.queries()["line_sentence_split"](spark, SF).agg(F.sum("n_sentences")).first()[0]
    assert got == registry.queries()["first_sentences"](spark, SF).count()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len([x for x in re.split(r"(?<=[.!?])\s+|\r?\n+", r.text, flags=re.ASCII) if x.strip(" \t\n\r\x0b\x0c")]) for r in docs if r.text}
    assert {r.doc_id: r.n_sentences for r in registry.queries()["line_sentence_split"](spark, SF).collect()} == {k: n for k, n in want.items() if n}


def test_attribute_rules_take_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = registry.queries()["attribute_rules"](spark, SF)
    assert got.count() == lines.count()
    english = got.filter("text like '% years'")
    assert english.count() == lines.filter("l_suppkey % 3 = 0").count() > 0
    assert english.filter("experience_years is null or experience_years < 1").count() == 0


def test_endpoint_check_misses_only_renamed_nodes(spark):
    edges = {(r.source, r.target, r.relation) for r in registry.queries()["build_edges"](spark, SF).collect()}
    got = {(r.source, r.target, r.relation) for r in registry.queries()["edge_endpoint_check"](spark, SF).collect()}
    assert got == {e for e in edges if e[0] != "s:3" and e[1] != "b:Brand#2"} and got < edges


def test_gazetteer_features_know_every_length(spark):
    words = [f"w{k}" for k in range(80)]
    rows = [(n, f"c{n}", "SKL" if n < 80 else "TOL", " ".join(words[:n]), "ESCO", "", []) for n in range(1, 81)]
    entries = spark.createDataFrame(rows, "ord bigint, canonical_id string, entity_type string, term string, source string, description string, aliases array<string>")
    docs = spark.createDataFrame([("1", words)], "id string, tokens array<string>")
    got = {r.pos: (r.span_len, r.types) for r in gazetteer.gazetteer_features(docs, entries).collect()}
    assert got == {k: (80, ["SKL", "TOL"] if k < 79 else ["TOL"]) for k in range(80)}

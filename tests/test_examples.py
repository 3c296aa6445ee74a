"""Pairs of a sentence are made inside its row."""

from skillweave.operators import bio, evaluation, fusion


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_need_no_join(spark):
    rows = [("1", "a b c", ["a", "b", "c"], ["B-OCC", "B-SKL", "B-TOL"]), ("2", "x y", ["x", "y"], ["B-OCC", "B-OCC"]), ("3", "q", ["q"], ["B-SKL"])]
    spans = bio.extract_spans(spark.createDataFrame(rows, "id string, text string, tokens array<string>, labels array<string>"))
    found = evaluation.relation_examples(spans)
    assert "Join" not in _plan(found) and "Exchange" not in _plan(found)
    got = sorted((r.id, r.head, r.tail, r.relation) for r in found.collect())
    assert got[:2] == [("1", "a", "b", "REQUIRES_SKILL"), ("1", "a", "c", "USES_TOOL")]
    assert len(got) == 3 and got[2] in [("2", "x", "y", "NO_RELATION"), ("2", "y", "x", "NO_RELATION")]
    assert "Filter" not in _plan(bio.nearest_occupation(spans))  # a filter on spans would make them again


def test_mentions_shrink_before_names_are_gathered(spark):
    rows = [("h", "H", "OCC", "t", "T", "SKL", k) for k in range(3)]
    records = spark.createDataFrame(rows, "head_id string, head_text string, head_type string, tail_id string, tail_text string, tail_type string, ord long")
    assert "min(ord" in _plan(fusion.fuse_nodes(records)).split("ObjectHashAggregate")[-1]

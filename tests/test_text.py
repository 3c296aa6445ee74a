import re

from pyspark.sql import functions as F

from skillweave import registry, schema
from skillweave.functions import text as fx
from skillweave.functions.similarity import indel_ratio_of
from skillweave.operators import bio

TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9+.#/\-]*|[一-鿿]|[^\w\s]")
TEXTS = ["Uses C++, C# and Node.js. 熟悉Python。", "été: déjà vu?! end.", "", "  ", "a_b 3.5 years (plus) 加分"]


def _one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_and_offsets(spark):
    got = _one(spark, fx.tokens, TEXTS)
    assert got == [[m[0] for m in TOKEN.finditer(t)] for t in TEXTS]
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string").withColumn("t", fx.tokens(F.col("x")))
    for r in df.withColumn("o", fx.token_offsets(F.col("x"), F.col("t"))).collect():
        assert [r.x[o.start : o.end] for o in r.o] == r.t


def test_sentences(spark):
    got = _one(spark, fx.sentences, ["One. Two!Three?  四。五", "no end", " ", "v1.2 is out. Yes"])
    assert got == [["One.", "Two!", "Three?", "四。", "五"], ["no end"], [""], ["v1.2 is out.", "Yes"]]


def test_keys(spark):
    assert _one(spark, fx.slug, ["C++", "Data  Science!"]) == ["c", "data_science"]
    assert _one(spark, fx.align_key, ["Node.JS (v2)", "数据 X"]) == ["node.jsv2", "数据x"]
    assert _one(spark, fx.name_key, ["Data　Scientist "]) == ["datascientist"]
    assert _one(spark, fx.aliases, ["a| b;a;;", None]) == [["a", "b"], []]


def test_titles(spark):
    raw = ["12/3 Senior Java Dev (remote)", "Senior", "5. backend developer docker", "React Native junior", "+++", "QA Lead + bonus pay"]
    assert _one(spark, fx.clean_title, raw) == ["Senior Java Dev", "Software Engineer", "backend developer docker", "React Native junior", "Software Engineer", "QA Lead"]


def test_attribute_rules(spark):
    texts = ["Expert in Go, 3.5 years", "familiar, nice to have", "surplus stock", "advanced 5年", "none"]
    assert _one(spark, fx.proficiency, texts) == ["expert", "familiar", None, "expert", None]
    assert _one(spark, fx.essential, texts) == [True, False, False, True, True]
    assert _one(spark, fx.experience_years, texts) == [3.5, None, None, 5.0, None]


def test_schema_and_similarity():
    assert len(schema.bio_labels()) == 15 and len(schema.RELATIONS) == 8 and len(schema.ENTITY_TYPES) == 7
    assert indel_ratio_of("硕士以上学历", "硕士学历") == 80.0
    assert indel_ratio_of("", "") == 100.0 and indel_ratio_of("ab", "cd") == 0.0


def test_titles_in_any_alphabet_and_bonus_notes(spark):
    titles = ["数据工程师", "Разработчик", "Python Dev + sign on bonus", "Python Dev + SignOn  bonus", "Analyst + welcome   bonus, now", "123", "Junior machine learning"]
    rows = spark.createDataFrame(list(enumerate(titles)), "n int, t string")
    got = [r.c for r in rows.select("n", fx.clean_title(F.col("t")).alias("c")).orderBy("n").collect()]
    assert got[:6] == ["数据工程师", "Разработчик", "Python Dev", "Python Dev", "Analyst", "Software Engineer"]
    assert rows.select(fx.tech_label(F.lit("machine learning lead")).alias("x")).first().x == "Machine Learning"


def test_spans_are_made_once_for_their_rows(spark):
    rows = [(1, "we use C++ and Python", ["we", "use", "C++", "and", "Python"], ["O", "O", "B-SKL", "O", "I-TOL"]), (2, "", [], []), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, tokens array<string>, labels array<string>")
    found = bio.span_rows(df)
    assert [(r.id, r.s.text, r.s.entity_type, r.s.start_char) for r in found.collect()] == [(1, "C++", "SKL", 7), (1, "Python", "TOL", 15)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sequence(0") == 1
    assert registry.queries()["bio_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("sequence(0") == 1

"""BIO labels and spans, row by row inside Spark's expressions: no shuffle, whatever the number of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions import text as fx
from skillweave.schema import RELATION_OF_TYPE


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def labels_of(offsets: Column, mentions: Column) -> Column:
    """BIO labels of tokens (array<struct<start,end>>) for mentions (array<struct<start,end,entity_type>>).

    A token takes the last mention, by (start, end), that overlaps it; its first token gets B.
    """

    def all_labels(ms: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            over = F.filter(ms, lambda m: (m["start"] < t["end"]) & (m["end"] > t["start"]))
            before = F.get(offsets, i - 1)

            def name(m: Column) -> Column:
                goes_on = F.coalesce((m["start"] < before["end"]) & (m["end"] > before["start"]), F.lit(False))
                return F.when(m.isNull(), F.lit("O")).otherwise(F.concat(F.when(goes_on, F.lit("I-")).otherwise(F.lit("B-")), m["entity_type"]))

            return let(F.get(over, F.size(over) - 1), name)

        return F.transform(offsets, one)

    ordered = F.array_sort(F.transform(mentions, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), i.alias("ord"), m["entity_type"].alias("entity_type"))))
    return let(ordered, all_labels)


def label_examples(df: DataFrame) -> DataFrame:
    """``df`` (text, mentions) with tokens, offsets and labels."""
    toks = df.withColumn("tokens", fx.tokens(F.col("text")))
    toks = toks.withColumn("offsets", fx.token_offsets(F.col("text"), F.col("tokens")))
    return toks.withColumn("labels", labels_of(F.col("offsets"), F.col("mentions")))


def spans_of(labels: Column, offsets: Column, text: Column) -> Column:
    """Entity spans: array<struct<text,entity_type,start_token,end_token,start_char,end_char>>.

    B opens a span, and so does I without an open span of its type; O ends it.  The shorter of the arrays counts.
    """

    def kind(x: Column) -> Column:
        return F.substring(x, 3, 100)

    def build(ls: Column) -> Column:
        n = F.size(ls)

        def opens(i: Column) -> Column:
            x, before = F.get(ls, i), F.get(ls, i - 1)
            lone = F.coalesce((before == "O") | (kind(before) != kind(x)), F.lit(True))
            return (x != "O") & (F.startswith(x, F.lit("B-")) | lone)

        def spans(at: Column) -> Column:
            def one(i: Column) -> Column:
                stop = F.coalesce(F.get(F.filter(at, lambda j: j > i), F.lit(0)), n)

                def cut(end: Column) -> Column:
                    a, b = F.get(offsets, i)["start"], F.get(offsets, end - 1)["end"]
                    return F.struct(
                        F.substring(text, a + 1, b - a).alias("text"),
                        kind(F.get(ls, i)).alias("entity_type"),
                        i.alias("start_token"),
                        (end - 1).alias("end_token"),
                        a.alias("start_char"),
                        b.alias("end_char"),
                    )

                return let(stop, cut)

            return F.transform(F.filter(at, opens), one)

        positions = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (opens(i) | (F.get(ls, i) == "O")))
        return let(positions, spans)

    size = F.least(F.size(labels), F.size(offsets))
    return let(F.slice(labels, F.lit(1), size), build)


def extract_spans(examples: DataFrame) -> DataFrame:
    """``examples`` (id, text, tokens, labels) with a column ``spans``."""
    offsets = fx.token_offsets(F.col("text"), F.col("tokens"))
    return examples.withColumn("offsets", offsets).withColumn("spans", spans_of(F.col("labels"), F.col("offsets"), F.col("text"))).drop("offsets")


def span_rows(examples: DataFrame) -> DataFrame:
    """id and a row ``s`` for each span of ``examples`` (id, text, tokens, labels).

    The spans are made inside explode: as a column of their own they would be made again for each filter on it.
    """
    found = let(fx.token_offsets(F.col("text"), F.col("tokens")), lambda offsets: spans_of(F.col("labels"), offsets, F.col("text")))
    return examples.select("id", F.explode(found).alias("s"))


def merge_tags(skill: Column, knowledge: Column) -> Column:
    """One label array from skill and knowledge tags (B, I, O); a skill tag wins; the shorter array counts."""

    def one(p: Column) -> Column:
        s, k = p["s"], p["k"]
        return F.when(s.isin("B", "I"), F.concat(s, F.lit("-SKL"))).when(k.isin("B", "I"), F.concat(k, F.lit("-KNW"))).otherwise(F.lit("O"))

    n = F.least(F.size(skill), F.size(knowledge))
    return F.transform(F.arrays_zip(F.slice(skill, F.lit(1), n).alias("s"), F.slice(knowledge, F.lit(1), n).alias("k")), one)


def nearest_pairs(spans: Column, relation: Column) -> Column:
    """array<struct<ord,relation,head,tail>> of one sentence's spans: each tail of a known ``relation`` with the nearest occupation."""
    numbered = F.transform(spans, lambda s, i: F.struct(s.alias("span"), i.alias("ord")))

    def pairs(occ: Column) -> Column:
        def one(x: Column) -> Column:
            near = F.array_min(F.transform(occ, lambda o: F.struct(F.abs(o["span"]["start_token"] - x["span"]["start_token"]).alias("gap"), o["ord"].alias("ord"), o["span"].alias("span"))))
            return F.struct(x["ord"].alias("ord"), relation[x["span"]["entity_type"]].alias("relation"), near["span"].alias("head"), x["span"].alias("tail"))

        tails = F.filter(numbered, lambda x: (F.size(occ) > 0) & (x["span"]["entity_type"] != "OCC") & relation[x["span"]["entity_type"]].isNotNull())
        return F.transform(tails, one)

    return let(F.filter(numbered, lambda s: s["span"]["entity_type"] == "OCC"), pairs)


def nearest_occupation(spans: DataFrame, kind_of_relation: dict[str, str] | None = None) -> DataFrame:
    """Each tail span with the occupation span of its sentence that starts nearest, the earlier one on ties.

    Input: id, text, spans.  Sentences without an occupation give nothing.  Output: id, span_ord, relation, head, tail, and
    essential, proficiency_level, experience_years from the 30 characters around the tail.
    """
    relation = F.create_map(*[F.lit(x) for pair in (kind_of_relation or RELATION_OF_TYPE).items() for x in pair])
    found = let(F.col("spans"), lambda spans: nearest_pairs(spans, relation))
    # The array is made inside explode: as a column of its own it would be made again for each filter on it.
    out = spans.select("id", "text", F.explode(found).alias("x"))
    context = fx.context_window(F.col("text"), F.col("x.tail.start_char"), F.col("x.tail.end_char"))
    return out.withColumn("context", context).select(
        "id",
        F.col("x.ord").alias("span_ord"),
        "x.relation",
        "x.head",
        "x.tail",
        fx.essential(F.col("context")).alias("essential"),
        F.lit(1).cast("long").alias("evidence_count"),
        fx.proficiency(F.col("context")).alias("proficiency_level"),
        fx.experience_years(F.col("context")).alias("experience_years"),
    )


def doccano_rows(examples: DataFrame) -> DataFrame:
    """id, text, labels array<struct<start,end,label>>, meta: what an annotation tool reads."""
    spans = extract_spans(examples)
    marks = F.transform("spans", lambda s: F.struct(s["start_char"].alias("start"), s["end_char"].alias("end"), s["entity_type"].alias("label")))
    meta = F.struct(F.col("lang").alias("lang"), F.col("tokens").alias("tokens"), F.col("labels").alias("weak_labels"))
    return spans.select("id", "text", marks.alias("marks"), meta.alias("meta")).withColumnRenamed("marks", "labels")


def gold_sample(examples: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` examples that have a label, the ones of lowest keyed hash: same rows for the same seed, at any partitioning."""
    marked = examples.filter(F.exists("labels", lambda x: x != "O"))
    return marked.orderBy(F.md5(F.concat_ws("|", F.col("id"), F.lit(str(seed)))), "id").limit(n)


def _is_title(x: Column) -> Column:
    return x.rlike(r"^[^\p{L}]*\p{Lu}[^\p{Lu}]*$") & x.rlike(r"^(?:[^\p{L}]*\p{Lu}\p{Ll}*)+[^\p{L}]*$")


def shape_features(x: Column, before: Column, after: Column, bos: Column, eos: Column) -> dict[str, Column]:
    """What a sequence tagger sees of a token and its neighbours (null where there is none), by name."""
    return {
        "lower": F.lower(x),
        "isupper": (F.upper(x) == x) & (F.lower(x) != x),
        "istitle": _is_title(x),
        "isdigit": x.rlike("^[0-9]+$"),
        "prefix1": F.substring(x, 1, 1),
        "prefix2": F.substring(x, 1, 2),
        "suffix1": F.right(x, F.lit(1)),
        "suffix2": F.right(x, F.lit(2)),
        "length": F.length(x),
        "bos": bos,
        "eos": eos,
        "prev_lower": F.lower(before),
        "prev_istitle": _is_title(before),
        "next_lower": F.lower(after),
        "next_istitle": _is_title(after),
    }


def token_features(examples: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """One row per token with its shape and neighbours: id, pos, token and the features of a sequence tagger.

    With the matches of a ``gazetteer`` (id, pos, types, span_len, begin, as gazetteer_features gives them) also
    gaz_hit, gaz_types, gaz_type, gaz_span_len and gaz_begin.
    """
    rows = examples.select("id", "tokens", F.posexplode("tokens").alias("pos", "token"))
    before, after = F.when(F.col("pos") > 0, F.get("tokens", F.col("pos") - 1)), F.get("tokens", F.col("pos") + 1)
    facts = shape_features(F.col("token"), before, after, F.col("pos") == 0, F.col("pos") == F.size("tokens") - 1)
    out = rows.select("id", "pos", "token", *[value.alias(name) for name, value in facts.items()])
    if gazetteer is None:
        return out
    hits = gazetteer.select("id", "pos", F.col("types").alias("gaz_types"), F.array_min("types").alias("gaz_type"), F.col("span_len").alias("gaz_span_len"), F.col("begin").alias("gaz_begin"))
    return out.join(hits, ["id", "pos"], "left").withColumn("gaz_hit", F.col("gaz_types").isNotNull())


def vocabulary(examples: DataFrame) -> DataFrame:
    """token, idx: ``<pad>`` 0, ``<unk>`` 1, then tokens by first appearance (doc_ord, position).

    Numbers come from counts of ranges of documents, so that no task sees the whole vocabulary.
    """
    rows = examples.select("doc_ord", F.posexplode("tokens").alias("pos", "token"))
    first = rows.groupBy("token").agg(F.min(F.struct("doc_ord", "pos")).alias("at"))
    ranged = first.withColumn("range", F.floor(F.col("at.doc_ord") / 1000))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("at"))
    numbered = ranged.withColumn("inside", inside).join(before, "range").select("token", (F.col("before") + F.col("inside") + 1).cast("long").alias("idx"))
    fixed = examples.sparkSession.createDataFrame([("<pad>", 0), ("<unk>", 1)], "token string, idx bigint")
    return fixed.unionByName(numbered)


def encode_padded(tokens: Column, ids: Column, width: int) -> Column:
    """Token ids by a map, unknown 1, cut or padded with 0 to ``width``."""
    found = F.transform(tokens, lambda t: F.coalesce(F.element_at(ids, t), F.lit(1)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0), width)), 1, width)


def padding_mask(tokens: Column, width: int) -> Column:
    return F.slice(F.concat(F.transform(tokens, lambda t: F.lit(True)), F.array_repeat(F.lit(False), width)), 1, width)

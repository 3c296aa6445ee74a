"""Aligning mentions with gazetteer entries: exact key, string similarity (vectors: see ``vectors``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions import sequences
from skillweave.functions import text as fx
from skillweave.functions.similarity import indel_ratio
from skillweave.operators.gazetteer import variants
from skillweave.session import materialise


def exact_index(entries: DataFrame) -> DataFrame:
    """entity_type, key -> the first entry that has the key."""
    rows = variants(entries).withColumn("key", fx.align_key(F.col("variant"))).filter(F.col("key") != "")
    return rows.groupBy("entity_type", "key").agg(F.min_by(F.struct("canonical_id", "source"), F.struct("ord", "variant_ord")).alias("hit"))


def exact_align(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """``mentions`` (entity_type, text) with canonical_id, source and score 100 where the key is known, else nulls."""
    # Names of its own, so that columns of the caller stay as they are.
    keyed = mentions.withColumn("_align_key", fx.align_key(F.col("text")))
    index = exact_index(entries).select("entity_type", F.col("key").alias("_align_key"), F.col("hit").alias("_align_hit"))
    hit = F.col("_align_hit")
    joined = keyed.join(index, ["entity_type", "_align_key"], "left")
    return joined.select(*mentions.columns, hit["canonical_id"].alias("canonical_id"), hit["source"].alias("source"), F.when(hit.isNotNull(), 100.0).alias("score"))


#: Characters in a gram, and what stands before and after a string.
GRAM, OPEN, CLOSE = 2, "\x02", "\x03"


def _needed(a: Column, b: Column, share: float) -> Column:
    """Grams that strings of lengths a and b have in common at least, if twice their LCS is 2 * ``share`` of both lengths.

    A character of one string outside the LCS spoils at most ``GRAM`` of its own grams, one of the other string one less.
    """
    common = F.ceil((a + b) * share - 1e-9)
    one = a + (GRAM - 1) - GRAM * (a - common) - (GRAM - 1) * (b - common)
    other = b + (GRAM - 1) - GRAM * (b - common) - (GRAM - 1) * (a - common)
    return F.greatest(one, other)


def _band(n: Column, share: float) -> Column:
    """Lengths that a string of length n can reach the score with, as an array."""
    low = F.ceil(n * share / (1 - share) - 1e-9)
    return F.sequence(low, F.greatest(F.floor(n * (1 - share) / share + 1e-9), low))


def grams_of(x: Column) -> Column:
    """array<struct<gram,k,pos>>: the k-th occurrence of each gram of a string with its ends marked, and where it starts."""
    marked = F.concat(F.lit(OPEN), x, F.lit(CLOSE))
    plain = F.transform(F.sequence(F.lit(1), F.length(marked) - GRAM + 1), lambda i: F.struct(F.substring(marked, i, F.lit(GRAM)).alias("gram"), i.alias("pos")))

    def number(state: Column, g: Column) -> tuple[Column, Column]:
        k = F.when(g["gram"] == state["gram"], state["k"] + 1).otherwise(F.lit(0))
        return F.struct(g["gram"].alias("gram"), k.alias("k")), F.struct(g["gram"].alias("gram"), k.alias("k"), g["pos"].alias("pos"))

    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("k"))
    return sequences.scan(F.array_sort(plain), start, number, "struct<gram:string,k:int,pos:int>")["out"]


def _strings(df: DataFrame, name: str, share: float) -> DataFrame:
    """Distinct (entity_type, ``name``) with length, grams, and the grams it needs of whatever it may meet."""
    n = F.length(name)
    least = F.array_min(F.transform(_band(n, share), lambda m: _needed(n.cast("bigint"), m, share)))
    return df.select("entity_type", name).distinct().withColumn("n", n).withColumn("least", least).withColumn("grams", grams_of(F.col(name)))


def _prefixes(strings: DataFrame, name: str, often: DataFrame) -> DataFrame:
    """The rarest grams of each string, one of which any string that is similar enough has among its own: gram, k, pos."""
    posted = strings.filter("least > 0").select("entity_type", name, "n", "least", F.size("grams").alias("size"), F.explode("grams").alias("g")).select("entity_type", name, "n", "least", "size", "g.*")
    place = F.row_number().over(Window.partitionBy("entity_type", name).orderBy(F.coalesce("often", F.lit(0)), "gram", "k"))
    ranked = posted.join(often, ["entity_type", "gram"], "left").withColumn("place", place)
    return ranked.filter(F.col("place") <= F.col("size") - F.col("least") + 1).select("entity_type", name, "n", "gram", "k", "pos")


def similar_pairs(mentions: DataFrame, variants_: DataFrame, min_score: float) -> DataFrame:
    """entity_type, low, vlow: the distinct pairs of strings that may reach ``min_score``, all that do among them.

    ``mentions`` has (entity_type, low), ``variants_`` (entity_type, vlow).  A pair has to share one of the rarest grams of
    both, at places that its insertions and deletions allow, fit in length, and have as many grams in common as the score
    needs.  Strings for which the score needs none (low scores, short strings) meet all of a fitting length.
    """
    share = min_score / 200
    own, pool = materialise(_strings(mentions, "low", share)), materialise(_strings(variants_, "vlow", share))  # both are read four times
    often = pool.select("entity_type", F.explode("grams").alias("g")).groupBy("entity_type", F.col("g.gram").alias("gram")).agg(F.count("*").alias("often"))
    p, q = _prefixes(own, "low", often).alias("p"), _prefixes(pool, "vlow", often).alias("q")
    common = F.ceil((F.col("p.n") + F.col("q.n")) * share - 1e-9)
    moved = F.col("q.pos") - F.col("p.pos")
    near = (moved >= common - F.col("p.n")) & (moved <= F.col("q.n") - common) & (common <= F.least("p.n", "q.n"))
    met = p.join(q, (F.col("p.entity_type") == F.col("q.entity_type")) & (F.col("p.gram") == F.col("q.gram")) & (F.col("p.k") == F.col("q.k")) & near)
    met = met.select("p.entity_type", "low", "vlow").distinct()
    keys = lambda g: F.transform(g, lambda x: F.struct(x["gram"], x["k"]))
    held = met.join(own.select("entity_type", "low", F.col("n").alias("a"), keys("grams").alias("u")), ["entity_type", "low"]).join(pool.select("entity_type", "vlow", F.col("n").alias("b"), keys("grams").alias("v")), ["entity_type", "vlow"])
    likely = held.filter(F.size(F.array_intersect("u", "v")) >= _needed(F.col("a"), F.col("b"), share)).select("entity_type", "low", "vlow")
    bare = own.select("entity_type", "low", "least", F.explode(_band(F.col("n"), share)).alias("m"))
    sized = pool.select("entity_type", "vlow", F.col("least").alias("vleast"), F.col("n").cast("bigint").alias("m"))
    rest = bare.join(sized, ["entity_type", "m"]).filter("least <= 0 or vleast <= 0").select("entity_type", "low", "vlow")
    return likely.unionByName(rest)


def fuzzy_candidates(mentions: DataFrame, entries: DataFrame, top_k: int = 5, min_score: float = 0.0) -> DataFrame:
    """The ``top_k`` most similar variants of each distinct mention (entity_type, text) of its type, ties by entry order.

    Different strings are scored once, however many mentions or entries have them; with a score to reach only those that
    ``similar_pairs`` lets through.  Of the entries with one string the first ``top_k`` are enough.
    """
    wanted = materialise(mentions.select("entity_type", "text").distinct().withColumn("low", F.lower("text")))
    first = F.row_number().over(Window.partitionBy("entity_type", "vlow").orderBy("ord", "variant_ord"))
    pool = materialise(variants(entries).withColumn("vlow", F.lower("variant")).withColumn("place", first).filter(F.col("place") <= top_k))
    if min_score > 0:
        pairs = similar_pairs(wanted, pool, min_score)
    else:
        pairs = wanted.select("entity_type", "low").distinct().join(pool.select("entity_type", "vlow").distinct(), "entity_type")
    scored = pairs.withColumn("score", indel_ratio(F.col("low"), F.col("vlow"))).filter(F.col("score") >= min_score)
    named = wanted.join(scored, ["entity_type", "low"]).join(pool, ["entity_type", "vlow"])
    rank = F.row_number().over(Window.partitionBy("entity_type", "text").orderBy(F.desc("score"), "ord", "variant_ord"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= top_k).select("entity_type", "text", "rank", "canonical_id", "variant", "source", "score")


def fuzzy_work(mentions: DataFrame, entries: DataFrame, min_score: float) -> DataFrame:
    """One row: mentions, variants (different strings), in_band (pairs whose lengths allow the score), scored, scored_per_mention."""
    own = mentions.select("entity_type", F.lower("text").alias("low")).distinct()
    pool = variants(entries).select("entity_type", F.lower("variant").alias("vlow")).distinct()
    share = min_score / 200
    banded = own.select("entity_type", F.explode(_band(F.length("low"), share)).alias("m")).groupBy("entity_type", "m").agg(F.count("*").alias("x"))
    lengths = pool.groupBy("entity_type", F.length("vlow").cast("bigint").alias("m")).agg(F.count("*").alias("y"))
    parts = [
        own.agg(F.count("*").alias("mentions")),
        pool.agg(F.count("*").alias("variants")),
        banded.join(lengths, ["entity_type", "m"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).cast("long").alias("in_band")),
        similar_pairs(own, pool, min_score).agg(F.count("*").alias("scored")),
    ]
    one = reduce(lambda x, y: x.join(F.broadcast(y), F.lit(True)), parts)  # one row each
    return one.withColumn("scored_per_mention", F.round(F.col("scored") / F.greatest("mentions", F.lit(1)), 4))


def align(mentions: DataFrame, entries: DataFrame, min_score: float = 85.0, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each distinct (entity_type, text) with canonical_id, source, score: exact first, else the best fuzzy one from ``min_score`` on.

    ``choose`` may re-rank the candidates of what is still open (down to ``min_score`` - 10) and return
    (entity_type, text, canonical_id, source, score).
    """
    entries = materialise(entries)
    exact = materialise(exact_align(mentions.select("entity_type", "text").distinct(), entries))
    known, rest = exact.filter(F.col("canonical_id").isNotNull()), exact.filter(F.col("canonical_id").isNull()).select("entity_type", "text")
    best = fuzzy_candidates(rest, entries, 1, min_score).select("entity_type", "text", "canonical_id", "source", "score")
    parts = [known, best]
    if choose is not None:
        still = rest.join(best, ["entity_type", "text"], "left_anti")
        parts.append(choose(fuzzy_candidates(still, entries, 5, min_score - 10)).select("entity_type", "text", "canonical_id", "source", "score"))
    found = reduce(DataFrame.unionByName, parts)
    return exact.select("entity_type", "text").join(found, ["entity_type", "text"], "left")


def align_relations(relations: DataFrame, entries: DataFrame, min_score: float = 85.0) -> DataFrame:
    """``relations`` (head, tail structs with entity_type and text) with canonical_id, source and score added to both.

    Distinct mentions are aligned once, then joined to both sides.
    """
    mentions = relations.select("head.entity_type", "head.text").unionByName(relations.select("tail.entity_type", "tail.text"))
    found = align(mentions, entries, min_score)
    out = relations
    for side in ("head", "tail"):
        own = found.select(F.col("entity_type").alias("_t"), F.col("text").alias("_x"), F.struct("canonical_id", "source", "score").alias("_hit"))
        out = out.join(own, (F.col(f"{side}.entity_type") == F.col("_t")) & (F.col(f"{side}.text") == F.col("_x")), "left")
        hit = F.struct(F.col(f"{side}.*"), F.col("_hit.canonical_id").alias("canonical_id"), F.col("_hit.source").alias("source"), F.col("_hit.score").alias("score"))
        out = out.withColumn(side, hit).drop("_t", "_x", "_hit")
    return out

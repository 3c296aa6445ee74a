"""Graph tables and what is derived from them: nodes, edges, similarity, prerequisites, components, paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import text as fx
from skillweave.operators import blocks

SKILL_RELATIONS = ("REQUIRES_SKILL", "USES_TOOL", "REQUIRES_KNOWLEDGE")


def edges_from(fused: DataFrame) -> DataFrame:
    """Edge rows of fused relations; evidence, essential and proficiency carry over; ``edge_ord`` is the first record's order."""
    return fused.groupBy(F.col("head_id").alias("source"), F.col("tail_id").alias("target"), "relation").agg(
        F.bool_or("essential").alias("essential"),
        F.sum("evidence_count").cast("long").alias("evidence_count"),
        F.min_by("proficiency_level", "ord").alias("proficiency_level"),
        F.min_by("experience_years", F.when(F.col("experience_years").isNotNull(), F.col("ord"))).alias("experience_years"),
        F.min("ord").alias("edge_ord"),
    )


def nodes_from(fused_nodes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Node rows: name from the gazetteer's term (the last of an id), names gathered from text, term and aliases, ``|``-joined."""
    base = fused_nodes.withColumn("names", F.col("alt_names"))
    if entries is not None:
        terms = entries.groupBy("canonical_id").agg(F.max_by("term", "ord").alias("term"), F.max_by("aliases", "ord").alias("aliases")).withColumnRenamed("canonical_id", "id")
        base = base.join(terms, "id", "left").withColumn("names", F.array_union(F.col("alt_names"), F.array_compact(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    else:
        base = base.withColumn("term", F.lit(None).cast("string"))
    primary = F.coalesce("term", "text")
    name = F.when(F.col("entity_type") == "OCC", fx.english_name(primary, F.col("names"))).otherwise(primary)
    return base.select("id", F.col("entity_type").alias("label"), name.alias("name"), "entity_type", "source", F.array_join(F.array_sort(F.array_distinct("names")), "|").alias("alt_names"), "node_ord")


def check_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both endpoints are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def skill_pairs(edges: DataFrame, relations: tuple[str, ...] = SKILL_RELATIONS) -> DataFrame:
    """Distinct (occ, skill)."""
    return edges.filter(F.col("relation").isin(*relations)).select(F.col("source").alias("occ"), F.col("target").alias("skill")).distinct()


def skill_classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, skills, n) of the different skill sets, each named by its least occupation, and (rep, occ, n) of their n members.

    Skills are 64-bit hashes.  The sets are computed once, by a checkpoint in the shared folder.
    """
    sets = pairs.groupBy("occ").agg(F.array_sort(F.collect_set(F.xxhash64("skill"))).alias("skills"))
    signed = _checkpoint(sets.select("occ", "skills", F.sha2(F.array_join(F.col("skills").cast("array<string>"), ","), 256).alias("sig")))
    groups = _checkpoint(signed.groupBy("sig").agg(F.first("skills").alias("skills"), F.min("occ").alias("rep"), F.count("occ").alias("n")))
    return groups.select("rep", "skills", "n"), signed.select("sig", "occ").join(groups.select("sig", "rep", "n"), "sig").select("rep", "occ", "n")


def _near(p: blocks.Block, q: blocks.Block, least: float, once: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """i, j, size of what is shared, size of the union: rows of two blocks of sets at least ``least`` similar.  With ``once`` both
    are of one table, and a block with itself has each pair once.

    One product tells similar pairs: shared * (1 + least) - least * (sum of sizes) is not negative.  Those near nought are
    decided by whole numbers.
    """
    u, v = p.matrix("<f4"), q.matrix("<f4", keep=True)
    nu, nv = p.lengths.astype("<f8"), q.lengths.astype("<f8")
    if not (len(nu) and len(nv)):
        return
    left = np.hstack([u * np.float32(1 + least), (-least * nu)[:, None].astype("<f4"), np.ones((len(u), 1), "<f4")])
    right = np.ascontiguousarray(np.hstack([v, np.ones((len(v), 1), "<f4"), (-least * nv)[:, None].astype("<f4")]).T)
    bar = -3e-4 * max(nu.max(), nv.max()) if least > 0 else 0.5
    for at in range(0, len(u), blocks.SLICE):
        score = left[at : at + blocks.SLICE] @ right
        place = np.flatnonzero(score.ravel() >= bar)
        i, j = np.divmod(place, len(v))
        value = score.ravel()[place]
        i += at
        if once and p.number == q.number:
            rising = i < j
            i, j, value = i[rising], j[rising], value[rising]
        sizes = nu[i] + nv[j]
        common = np.rint((value + least * sizes) / (1 + least))
        union = sizes - common
        kept = (common > 0) & (common / np.maximum(union, 1) >= least - 1e-9)
        if kept.any():
            yield i[kept], j[kept], common[kept], union[kept]


def _reach(least: float) -> Callable[..., bool]:
    """Whether sets of sizes from low to high on both sides can be ``least`` similar."""
    return lambda p_low, p_high, q_low, q_high: p_high >= q_low * least - 1e-9 and q_high >= p_low * least - 1e-9


def _rows(sets: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and skills of ``sets`` as rows to pack."""
    return sets.select(*columns, F.size("skills").alias("n"), F.col("skills").alias("items"), F.transform("skills", lambda x: F.lit(1.0)).alias("weights"))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link a[k] with b[k] in ``label``, where every vertex has the least one that it is linked with so far."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            short = label[label]
            if (short == label).all():
                break
            label[:] = short


def _block_links(left: DataFrame, right: DataFrame, words: np.ndarray, least: float, kind: str, once: bool) -> DataFrame:
    """x, y: links between vertices (column ``part``) of which a pair of blocks has similar sets; only as many as connect them."""

    def work(p: blocks.Block, q: blocks.Block) -> Iterator[list]:
        both = p["part"] if p.number == q.number and once else pa.concat_arrays([p["part"], q["part"]])
        coded = both.dictionary_encode()
        codes = coded.indices.to_numpy()
        u, v = codes[: len(p)], codes[-len(q) :]
        label = np.arange(len(coded.dictionary))
        for i, j, _, _ in _near(p, q, least, once):
            _join(label, u[i], v[j])
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield [coded.dictionary.take(pa.array(label[moved])), coded.dictionary.take(pa.array(moved))]

    return blocks.pairs(left, right, words, work, f"x {kind}, y {kind}", _reach(least), once=once)


#: Sets, about, that all sets meet first, where there are over four times as many.
HUB = 8_192


def linked_classes(classes: DataFrame, least: float) -> DataFrame:
    """a, b: links between sets (rep, skills) that connect those at least ``least`` similar, not always all of them.

    Many sets meet a part of them first, chosen by hash; that mostly leaves one large component.  Then only what is outside of
    the largest one meets all sets: every link between two components has an end there.
    """
    words = blocks.vocabulary(classes.select(F.explode("skills")))
    if words is None:
        return similar_classes(classes, least).select(F.col("x").alias("a"), F.col("y").alias("b"))
    classes = classes.filter("rep is not null")
    kind = classes.schema["rep"].dataType.simpleString()
    own = classes.withColumn("part", F.col("rep"))
    pack = lambda df: blocks.pack(_rows(df, "part"), words, ["n", "part"])
    held, n = pack(own), classes.count()
    if n <= 4 * HUB:
        return _block_links(held, held, words, least, kind, True).select(F.col("x").alias("a"), F.col("y").alias("b"))
    hub = own.filter(F.pmod(F.xxhash64("rep", F.lit("hub")), F.lit(-(-n // HUB))) == 0)
    first = contract(_block_links(held, pack(hub), words, least, kind, False).select(F.col("x").alias("a"), F.col("y").alias("b")))
    largest = first.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).select(F.col("a").alias("part"))  # one row
    parts = _checkpoint(classes.join(first.select(F.col("b").alias("rep"), F.col("a").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep")))
    outside = parts.join(F.broadcast(largest), "part", "left_anti")
    rest = _block_links(pack(outside), pack(parts), words, least, kind, False)
    return first.unionByName(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def similar_classes(classes: DataFrame, least: float) -> DataFrame:
    """x, y, jaccard of different sets (rep, skills) that share a skill and are at least ``least`` similar.

    Of few different skills (``blocks.MOST_ITEMS``) each is held by many sets: there, sets are compared in blocks.
    """
    words = blocks.vocabulary(classes.select(F.explode("skills")))
    if words is None:
        return _prefix_pairs(classes, least)
    held = blocks.pack(_rows(classes, "rep"), words, ["n", "rep"])

    def work(p: blocks.Block, q: blocks.Block) -> Iterator[list]:
        for i, j, common, union in _near(p, q, least, True):
            yield [p["rep"].take(pa.array(i)), q["rep"].take(pa.array(j)), pa.array(common / union)]

    kind = classes.schema["rep"].dataType.simpleString()
    found = blocks.pairs(held, held, words, work, f"x {kind}, y {kind}, jaccard double", _reach(least), once=True)
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "jaccard")


def _prefix_pairs(classes: DataFrame, least: float) -> DataFrame:
    """The pairs of ``similar_classes`` over many different skills.

    Skills are ordered by how many sets hold them, rarest first; two sets that are similar enough share one of the first
    skills of both, so only those are joined, within the sizes that can reach ``least``, and popular skills mostly meet
    nothing.  What is found is checked on the whole sets.
    """
    posted = classes.select("rep", F.size("skills").alias("n"), F.explode("skills").alias("skill"))
    often = posted.groupBy("skill").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("often", "skill"))
    first = posted.join(often, "skill").select("rep", "n", "skill", place.alias("place")).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    p, q = first.alias("p"), first.alias("q")
    together = F.ceil((F.col("p.n") + F.col("q.n")) * (least / (1 + least)) - 1e-9)
    early = (F.col("p.place") <= F.col("p.n") - together + 1) & (F.col("q.place") <= F.col("q.n") - together + 1)
    sizes = (F.col("p.n") >= F.col("q.n") * least - 1e-9) & (F.col("q.n") >= F.col("p.n") * least - 1e-9)
    likely = p.join(q, (F.col("p.skill") == F.col("q.skill")) & (F.col("p.rep") < F.col("q.rep")) & sizes & early).select(F.col("p.rep").alias("x"), F.col("q.rep").alias("y")).distinct()
    held = likely.join(classes.select(F.col("rep").alias("x"), F.col("skills").alias("u")), "x").join(classes.select(F.col("rep").alias("y"), F.col("skills").alias("v")), "y")
    common = F.size(F.array_intersect("u", "v"))
    return held.select("x", "y", (common / (F.size("u") + F.size("v") - common)).alias("jaccard")).filter(F.col("jaccard") >= least - 1e-9)


def _set_pairs(pairs: DataFrame, least: float, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """x <= y, jaccard of skill sets at least ``least`` similar, each with itself too, and the members (set, occ) to write.

    A set is (rep, n): its name, and how many members there are to write at most.
    """
    classes, members = skill_classes(pairs.filter(F.col("occ").isNotNull()))
    n = F.col("n")
    if keep is not None:
        members = members.filter((F.col("occ") == F.col("rep")) | F.col("occ").isin(*keep))
        n = F.least(n, F.lit(len(keep) + 1).cast("long"))
    one = F.struct("rep", n.alias("n"))
    named = classes.select(one.alias("rep"), "skills")
    itself = named.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("jaccard"))
    return similar_classes(named, least).unionByName(itself), members.select(one.alias("set"), "occ")


#: Occupations of a chunk of a skill set's members, about.
CHUNK = 512


def _write_pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """a, b and the columns of ``found`` (x, y, ...) for all members a, b of the sets x and y, a <> b, in both directions.

    Members are dealt into chunks by hash, and pairs of chunks to tasks: the pairs of one set, however many it holds, are
    written by all tasks, each of which has two chunks at a time.
    """
    spark = found.sparkSession
    values = [c for c in found.columns if c not in ("x", "y")]
    n_chunks = lambda n: F.ceil(n / CHUNK)
    chunks = _checkpoint(members.groupBy("set", F.pmod(F.xxhash64("occ"), n_chunks(F.col("set.n"))).alias("k")).agg(F.collect_list("occ").alias("occs")))
    p, q = chunks.select(F.col("set").alias("x"), F.col("k").alias("i"), F.col("occs").alias("p")), chunks.select(F.col("set").alias("y"), F.col("k").alias("j"), F.col("occs").alias("q"))
    numbers = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), n_chunks(F.col(f"{side}.n")) - 1))
    ids = found.select("*", numbers("x").alias("i")).select("*", numbers("y").alias("j")).filter((F.col("x") != F.col("y")) | (F.col("i") <= F.col("j")))
    met = ids.join(p, ["x", "i"]).join(q, ["y", "j"]).repartition(blocks.TASKS_A_CORE * spark.sparkContext.defaultParallelism, "x", "y", "i", "j")
    itself = (F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))
    one, other = F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"))
    ways = met.select(*values, itself.alias("itself"), F.explode(F.when(itself, F.array(one)).otherwise(F.array(one, other))).alias("way"))
    heads = ways.select(*values, "itself", F.explode("way.p").alias("a"), "way.q")
    return heads.select("a", F.explode(F.when(F.col("itself"), F.array_remove("q", F.col("a"))).otherwise(F.col("q"))).alias("b"), *values)


#: Pairs in a batch of rows, at most; occupations a skill set, on average, beyond which pairs of sets are found first.
BATCH, SHARED = 1 << 17, 4


def _occupation_sets(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """occ, skills (64-bit hashes), stored.  With ``keep``, only the least occupation of each skill set and those in ``keep``."""
    if keep is None:
        return _checkpoint(pairs.filter(F.col("occ").isNotNull()).groupBy("occ").agg(F.array_sort(F.collect_set(F.xxhash64("skill"))).alias("skills")))
    classes, members = skill_classes(pairs.filter(F.col("occ").isNotNull()))
    kept = members.filter((F.col("occ") == F.col("rep")) | F.col("occ").isin(*keep))
    return _checkpoint(kept.select("rep", "occ").join(classes.select("rep", "skills"), "rep").select("occ", "skills"))


def _skills_of(sets: DataFrame) -> DataFrame:
    """occ, skill of stored sets."""
    return sets.select("occ", F.explode("skills").alias("skill"))


def _table(score: Callable[[float], float], words: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``score`` of Jaccard similarities (shared, size of the union), worked out once for each two numbers."""
    held = {}

    def look_up(common: np.ndarray, union: np.ndarray) -> np.ndarray:
        known = held.setdefault("known", np.full((len(words) + 1) * (2 * len(words) + 1), np.nan))
        code = (common * (2 * len(words) + 1) + union).astype("<i8")
        value = known[code]
        new = np.unique(code[np.isnan(value)])
        if len(new):
            c, u = np.divmod(new, 2 * len(words) + 1)
            known[new] = [score(x) for x in (c / u).tolist()]
            value = known[code]
        return value

    return look_up


def _pairs_in_blocks(sets: DataFrame, least: float, score: Callable[[float], float], kind: str) -> DataFrame | None:
    """a, b, value: the ``score`` of all pairs of occupations (occ, skills) at least ``least`` similar, in both directions, those
    scored below 0 left out.  None if there are too many different skills for blocks, or so many equal sets that pairs of sets
    (``_set_pairs``) are few beside those to write.

    A pair is written by the task that finds it: neither found nor written pairs are shuffled or stored.  Python hands over what
    is near to an occupation as an array, and rows are made of it in both directions by Spark.
    """
    words = blocks.vocabulary(sets.select(F.explode("skills")))
    every, different = sets.agg(F.count("*"), F.countDistinct(F.xxhash64("skills"))).first()
    if words is None or every > SHARED * different:
        return None
    held = blocks.pack(_rows(sets, "occ"), words, ["n", "occ"], CHUNK)
    look_up = _table(score, words)
    number = "<f8" if kind == "double" else "<i8"

    def work(p: blocks.Block, q: blocks.Block) -> Iterator[list]:
        for i, j, common, union in _near(p, q, least, True):
            value = look_up(common, union)
            kept = value >= 0
            i, j, value = i[kept], j[kept], value[kept].astype(number)
            for at in range(0, len(i), BATCH):
                part = slice(at, at + BATCH)
                first = np.flatnonzero(np.r_[True, np.diff(i[part]) != 0]).astype("<i4")
                ends = pa.array(np.r_[first, len(i[part])].astype("<i4"))
                near = pa.StructArray.from_arrays([q["occ"].take(pa.array(j[part])), pa.array(value[part])], ["b", "value"])
                yield [p["occ"].take(pa.array(i[part][first])), pa.ListArray.from_arrays(ends, near)]

    name = sets.schema["occ"].dataType.simpleString()
    found = blocks.pairs(held, held, words, work, f"a {name}, near array<struct<b: {name}, value: {kind}>>", _reach(least), once=True)
    one = found.select("a", F.inline("near"))
    return one.select(F.stack(F.lit(2), "a", "b", "value", "b", "a", "value").alias("a", "b", "value"))


def similar_sets(pairs: DataFrame, least: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """a < b, jaccard for all occupations that share a skill and are at least ``least`` similar.

    Every pair is written out, of equal sets too; ``skill_classes`` and ``similar_classes`` have the same without that.
    With ``keep``, only the pairs among the least occupation of each skill set and those in ``keep``.
    """
    sets = _occupation_sets(pairs, keep)
    found = _pairs_in_blocks(sets, least, lambda x: x, "double")
    if found is None:
        return _write_pairs(*_set_pairs(_skills_of(sets), least, keep)).filter("a < b")
    return found.filter("a < b").withColumnRenamed("value", "jaccard")


def similarity_edges(edges: DataFrame, least: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """SIMILAR_TO in both directions, evidence = whole percent of the Jaccard similarity.

    With ``keep`` (``similar_sets``) a cheapest path between two occupations in ``keep`` is the same as over all edges: what
    has one skill set has the same neighbours at the same cost, so a path takes one of a set, the least on ties, and leaves
    its ends' sets at once.
    """
    sets = _occupation_sets(skill_pairs(edges), keep)
    found = _pairs_in_blocks(sets, least, lambda x: floor(x * 100) if x >= least else -1, "long")
    if found is None:
        classes, members = _set_pairs(_skills_of(sets), least, keep)
        scored = classes.filter(F.col("jaccard") >= least).select("x", "y", F.floor(F.col("jaccard") * 100).cast("long").alias("value"))
        found = _write_pairs(scored, members)
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("value").alias("evidence_count"), F.lit("SIMILAR_TO").alias("relation"))


def skill_degree(edges: DataFrame) -> DataFrame:
    """target, degree: evidence summed over skill edges, missing or zero evidence counting 1."""
    return edges.filter(F.col("relation").isin(*SKILL_RELATIONS)).groupBy("target").agg(F.sum(F.coalesce(F.nullif(F.col("evidence_count"), F.lit(0)), F.lit(1))).cast("long").alias("degree"))


def prerequisite_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PREREQUISITE_OF between SKL nodes next to each other by rising degree: source, target, relation.

    Degrees are ranges: the link between two ranges joins the last node of one with the first of the next, so only the
    list of degrees is ordered in one place.
    """
    skills = nodes.filter(F.col("entity_type") == "SKL").select("id", "node_ord").join(skill_degree(edges).withColumnRenamed("target", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    inside = skills.withColumn("next", F.lead("id").over(Window.partitionBy("degree").orderBy("node_ord", "id")))
    ends = skills.groupBy("degree").agg(F.min_by("id", F.struct("node_ord", "id")).alias("first"), F.max_by("id", F.struct("node_ord", "id")).alias("last"))
    bridges = ends.withColumn("next", F.lead("first").over(Window.orderBy("degree"))).filter(F.col("next").isNotNull()).select(F.col("last").alias("source"), F.col("next").alias("target"))
    links = inside.filter(F.col("next").isNotNull()).select(F.col("id").alias("source"), F.col("next").alias("target"))
    return links.unionByName(bridges).withColumn("relation", F.lit("PREREQUISITE_OF"))


def dense_fallback(edges: DataFrame, most: float = 0.85, decimals: int | None = None) -> DataFrame:
    """source, target, weight between occupations at Jaccard distance of at most ``most``, for graphs without SIMILAR_TO.

    Weights are rounded to ``decimals``, if given: once for two skill sets, not for each pair of their occupations.
    """
    sets, least = _occupation_sets(skill_pairs(edges)), max(1 - most, 0.0)

    def score(x: float) -> float:
        weight = 1 - x + 1e-4
        return -1 if 1 - x > most else weight if decimals is None else _rounded(weight, decimals)

    found = _pairs_in_blocks(sets, least, score, "double")
    if found is None:
        classes, members = _set_pairs(_skills_of(sets), least)
        weight = 1 - F.col("jaccard") + 1e-4
        near = classes.filter(1 - F.col("jaccard") <= most).select("x", "y", (weight if decimals is None else F.round(weight, decimals)).alias("value"))
        found = _write_pairs(near, members)
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("value").alias("weight"))


def _rounded(x: float, decimals: int) -> float:
    """As Spark rounds a double: half up, by its shortest digits."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half of a contraction: larger neighbours, or a vertex and its smaller ones, link with the least vertex around."""
    near = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        near = near.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    both = near.join(least, "u")
    out = both.filter("v > u" if large else "v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def contract(links: DataFrame) -> DataFrame:
    """a, b: each vertex b of ``links`` (a, b) with the least vertex a that it reaches, in rounds of stars.

    A round leaves at most one link a vertex beside those of the links it began with, so what is written shrinks to the
    number of vertices; it ends when a checksum stays.  Each round is a checkpoint in the shared folder.
    """
    now = _checkpoint(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = _checkpoint(_star(_star(now, True), False))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now
        mark = seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (least id reachable, directions ignored) over edges with both endpoints known."""
    known = check_endpoints(edges.select("source", "target"), nodes)
    found = contract(known.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return nodes.select("id").distinct().join(found.select(F.col("b").alias("id"), "a"), "id", "left").select("id", F.coalesce("a", "id").alias("component"))


def similar_components(pairs: DataFrame, least: float) -> DataFrame:
    """occ, component of occupations (occ, skill) linked at a Jaccard similarity of at least ``least``, without their pair list.

    Occupations of one skill set are one vertex, linked through their least member.
    """
    classes, members = skill_classes(pairs)
    found = contract(linked_classes(classes, least))
    # The least member of a component is that of its least class, as classes are named by their least member.
    return members.join(found.select(F.col("b").alias("rep"), "a"), "rep", "left").select("occ", F.coalesce("a", "rep").alias("component"))


def components_by_similarity(nodes: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """id, component of ``nodes`` linked where their skill sets are at least ``least`` similar, without writing those links."""
    known = nodes.select("id").distinct()
    found = similar_components(skill_pairs(edges).join(known.withColumnRenamed("id", "occ"), "occ", "left_semi"), least)
    return known.join(found.withColumnRenamed("occ", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _checkpoint(df: DataFrame) -> DataFrame:
    from skillweave.session import materialise

    return materialise(df)


#: Decimals of a path's cost: sums of rounded weights don't depend on their order.
COST_DECIMALS = 12


def _cost(x: Column) -> Column:
    return F.round(x, COST_DECIMALS)


def _over(links: DataFrame) -> Callable[[DataFrame, bool], DataFrame]:
    """(front, forward) -> id, distance, path: what a front reaches over one of ``links``, path being the front's."""
    links = _checkpoint(links.select("source", "target", _cost(F.col("weight").cast("double")).alias("weight")))  # each round reads it

    def step(front: DataFrame, forward: bool) -> DataFrame:
        here, there = ("source", "target") if forward else ("target", "source")
        return front.join(links, front["id"] == links[here]).select(links[there].alias("id"), _cost(F.col("distance") + F.col("weight")).alias("distance"), "path")

    return step


def _spread(best: DataFrame, reached: DataFrame, forward: bool) -> tuple[DataFrame, DataFrame]:
    """One round from one end: what the front has ``reached`` over one link, where it is cheaper (or as cheap by a lesser path)."""
    path = F.concat("path", F.array("id")) if forward else F.concat(F.array("id"), F.col("path"))
    step = reached.select("id", F.struct("distance", path.alias("path")).alias("offer"))
    joined = _checkpoint(best.join(step.groupBy("id").agg(F.min("offer").alias("offer")), "id", "full"))
    old = F.when(F.col("distance").isNotNull(), F.struct("distance", "path"))
    better = F.col("offer").isNotNull() & (old.isNull() | (F.col("offer") < old))
    chosen = F.when(better, F.col("offer")).otherwise(old)
    return joined.select("id", chosen["distance"].alias("distance"), chosen["path"].alias("path")), joined.filter(better).select("id", "offer.distance", "offer.path")


def shortest_paths(links: DataFrame, source: str, target: str, max_rounds: int | None = None) -> DataFrame:
    """One row: distance and path (array of ids) of the cheapest path over directed ``links`` (source, target, weight >= 0).

    The search goes from both ends, a round from the end with the smaller front at a time, and keeps the cheapest way of
    each node it has reached (ties: the lesser path; costs are compared to ``COST_DECIMALS`` decimals).  A path that isn't
    known yet has to pass both fronts, so it ends when the least of both together exceed the best path, when a front has
    nothing left, or after ``max_rounds`` links.  Nodes that can't be on a better path are not spread from.
    """
    return _search(links.sparkSession, _over(links), source, target, max_rounds)


def _search(spark: SparkSession, step: Callable[[DataFrame, bool], DataFrame], source: str, target: str, max_rounds: int | None) -> DataFrame:
    """The rounds of ``shortest_paths``, where ``step`` says what a front reaches over one link."""
    start = lambda node: spark.createDataFrame([(node, 0.0, [node])], "id string, distance double, path array<string>")
    best = {True: start(source), False: start(target)}
    front, least, size = dict(best), {True: 0.0, False: 0.0}, {True: 1, False: 1}
    found = (0.0, [source]) if source == target else None
    k = 0

    def narrow(side: bool, nodes: DataFrame) -> None:
        bound = least[not side]
        front[side] = nodes if found is None else nodes.filter(_cost(F.col("distance") + bound) <= found[0])
        seen = front[side].agg(F.count("*").alias("n"), F.min("distance").alias("least")).first()
        size[side], least[side] = seen.n, seen.least if seen.n else float("inf")

    while min(size.values()) and (found is None or round(least[True] + least[False], COST_DECIMALS) <= found[0]) and (max_rounds is None or k < max_rounds):
        k += 1
        side = size[True] <= size[False]
        best[side], improved = _spread(best[side], step(front[side], side), side)
        other = best[not side].select("id", F.col("distance").alias("rest"), F.col("path").alias("other"))
        head, tail = ("path", "other") if side else ("other", "path")
        whole = F.concat(head, F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0))))
        met = improved.join(other, "id").agg(F.min(F.struct(_cost(F.col("distance") + F.col("rest")).alias("distance"), whole.alias("path"))).alias("w")).first().w
        news = met is not None and (found is None or (met.distance, met.path) < found)
        found = (met.distance, met.path) if news else found
        narrow(side, improved)
        if news:
            narrow(not side, front[not side])
    return spark.createDataFrame([found] if found else [], "distance double, path array<string>")


def similar_paths(edges: DataFrame, least: float, source: str, target: str, weighted: bool, max_rounds: int | None = None) -> DataFrame:
    """``shortest_paths`` over the SIMILAR_TO edges of ``similarity_edges(edges, least)``, ``weighted`` by ``similarity_weights`` or
    in ``undirected_steps``, without those edges.

    One occupation of each skill set and both ends are the nodes.  In a round the front meets them in blocks, and of what it
    offers a node only the best leaves a task: what is shuffled grows with the nodes, not with their similar pairs.
    """
    sets = _occupation_sets(skill_pairs(edges), [source, target])
    words = blocks.vocabulary(sets.select(F.explode("skills")))
    if words is None:
        near = similarity_edges(edges, least, [source, target])
        return shortest_paths(similarity_weights(near) if weighted else undirected_steps(near), source, target, max_rounds)
    held = blocks.pack(_rows(sets, "occ"), words, ["n", "occ"])
    unit = 10**COST_DECIMALS

    def cost(x: float) -> float:
        return -1 if x < least else round(_rounded(1 / max(floor(x * 100), 1), COST_DECIMALS) * unit) if weighted else unit

    look_up = _table(cost, words)

    def work(p: blocks.Block, q: blocks.Block) -> Iterator[list]:
        if "rank" not in q.found:
            paths = q["path"].to_pylist()
            order = sorted(range(len(q)), key=paths.__getitem__)
            rank = np.empty(len(q), "<i8")
            rank[order] = np.arange(len(q))
            distance = np.rint(q["distance"].to_numpy() * unit).astype("<i8")
            q.found.update(rank=rank, sorted=[paths[k] for k in order], least=distance.min(), more=distance - distance.min())
        best = np.full(len(p), np.iinfo("<i8").max)
        for i, j, common, union in _near(p, q, least):
            price = look_up(common, union)
            i, j, price = i[price >= 0], j[price >= 0], price[price >= 0].astype("<i8")
            if len(i):
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                best[i[first]] = np.minimum.reduceat((q.found["more"][j] + price) * blocks.MOST_ROWS + q.found["rank"][j], first)
        if "cost" not in p.found:
            p.found.update(cost=np.full(len(p), np.iinfo("<i8").max), path=[None] * len(p))
        old, path = p.found["cost"], p.found["path"]
        reached = np.flatnonzero(best < np.iinfo("<i8").max)
        price, rank = best // blocks.MOST_ROWS + q.found["least"], best % blocks.MOST_ROWS
        for k in reached[price[reached] <= old[reached]].tolist():
            own = q.found["sorted"][rank[k]]
            if price[k] < old[k] or own < path[k]:
                old[k], path[k] = price[k], own
        return iter(())

    def finish(p: blocks.Block) -> Iterator[list]:
        some = [k for k, x in enumerate(p.found.get("path", [])) if x is not None]
        for at in range(0, len(some), 1_024):
            part = some[at : at + 1_024]
            yield [p["occ"].take(pa.array(part)), pa.array(p.found["cost"][part] / unit), pa.array([p.found["path"][k] for k in part], pa.list_(pa.string()))]

    def step(front: DataFrame, forward: bool) -> DataFrame:
        rows = _rows(front.join(sets.withColumnRenamed("occ", "id"), "id"), "distance", "path")
        return blocks.pairs(held, blocks.pack(rows, words, ["n", "path"]), words, work, "id string, distance double, path array<string>", _reach(least), finish)

    return _search(edges.sparkSession, step, source, target, max_rounds)


def similarity_weights(edges: DataFrame) -> DataFrame:
    """Directed links of SIMILAR_TO edges, weight 1 / max(evidence, 1); of repeated edges the last counts."""
    own = edges.filter(F.col("relation") == "SIMILAR_TO")
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0)
    last = own.groupBy("source", "target").agg(F.max_by("evidence_count", F.struct(order.alias("o"), "evidence_count")).alias("evidence_count"))
    return last.select("source", "target", (1 / F.greatest(F.col("evidence_count"), F.lit(1))).alias("weight"))


def undirected_steps(edges: DataFrame) -> DataFrame:
    """Links of weight 1 in both directions of SIMILAR_TO edges."""
    own = edges.filter(F.col("relation") == "SIMILAR_TO").select("source", "target")
    return own.unionByName(own.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().withColumn("weight", F.lit(1.0))


def growth_steps(path: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """step, source, target, new_skills: names of skills that each hop of ``path`` adds, fewest prerequisites first, then by name."""
    hops = path.select(F.posexplode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x, i: F.struct(x.alias("source"), F.get("path", i + 1).alias("target"))))).select(F.col("pos").alias("step"), "col.source", "col.target")
    own = skill_pairs(edges)
    prerequisites = edges.filter(F.col("relation") == "PREREQUISITE_OF").groupBy(F.col("target").alias("skill")).agg(F.count("*").alias("n"))
    gained = hops.join(own.withColumnRenamed("occ", "target"), "target").join(own.withColumnRenamed("occ", "source"), ["source", "skill"], "left_anti")
    named = gained.join(prerequisites, "skill", "left").join(nodes.select(F.col("id").alias("skill"), "name"), "skill")
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.coalesce("n", F.lit(0)), "name"))
    first = named.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("new_skills"))
    return hops.join(first, "step", "left").select("step", "source", "target", F.coalesce("new_skills", F.array().cast("array<string>")).alias("new_skills"))


def hit(x: Column, names: list[str]) -> Column:
    """Whether a name is among ``names``, compared without case and white space."""
    return fx.name_key(x).isin(*["".join(n.lower().split()) for n in names]) if names else F.lit(False)

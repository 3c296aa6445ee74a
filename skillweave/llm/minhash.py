"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document's set is hashed once: its hashes fall in ``BINS`` equal ranges, and each range's least hash is one entry of the
signature.  An empty bin takes the entry of another one, the first filled bin in an order of its own that all documents
share; so two sets of any sizes agree in each bin with the probability of their similarity.  ``BAND`` bins make a band;
documents with an equal band are in one bucket.  A pair at the threshold of 0.85 shares none of the 48 buckets with a
probability of 2e-10, a closer one with less.

Documents of equal sets form a class first, of which one member goes on.  A bucket emits a star: each of its members and
its least one, so pairs grow with the members.  Each is confirmed on the whole sets; links make components.  What stars
can't tell are links between two members of a bucket whose components still differ.  Those members, and only those, go
through an exact join: their rarest elements first, they meet in the lists of so many elements that linked sets share one
of them, and what the sizes and places still allow is confirmed on the whole sets, too.

Words are runs of characters other than ASCII white space, A-Z as a-z; elements are 64-bit hashes of ``SHINGLE`` words.  A
text of fewer words has one element, all its words.  A null text, or one without words, has no elements and links with
nothing: its component is its own doc_id.  Repeated rows are equal sets.  doc_id is a number (any type that casts to
bigint); rows without one link with nothing.  Rows that share a doc_id should share its text.  Very long texts are one
set each.  Other columns are ignored (``one_of_each`` keeps them).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.llm.components import connected_components
from skillweave.llm.shared import Scratch, WordHasher, mix, rows_in, rows_not_in, slices, small_batches, text_buffers, words_of, write_table

SHINGLE = 3
#: Similarity as a fraction: 85/100.
NUM, DEN = 17, 20
BAND, BINS = 6, 288
#: Members of a star that are confirmed in one place, about.
STAR_CHUNK = 256
#: Elements of open documents with a count of at least ``COMMON`` are ordered by it, as long as there are at most so many.
COMMON, MOST_COMMON = 4, 2_000_000
#: Classes with at least this part of all rows are broadcast, so there are at most as many.
HOT_PART = 1_000


@cache
def _hasher() -> WordHasher:
    return WordHasher.split_on_spaces()


_TURNS = mix(np.arange(201, 201 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def sets_of(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, first = words_of(_hasher(), raw, offsets)
    out = []
    with np.errstate(over="ignore"):
        whole = np.zeros(0, np.uint64)
        if len(words) >= SHINGLE:
            whole = mix(np.sum([words[k : len(words) - SHINGLE + 1 + k] * turn for k, turn in enumerate(_TURNS)], axis=0, dtype=np.uint64))
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if high - low >= SHINGLE:
                out.append(np.unique(whole[low : high - SHINGLE + 1]))
            elif high > low:
                out.append(mix((words[low:high] * _TURNS[: high - low]).sum(dtype=np.uint64, keepdims=True) + np.uint64(high - low)))
            else:
                out.append(whole[:0])
    return out


@cache
def _bins() -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each bin, and each bin's order of all bins: place[i, j] is where bin j stands for bin i."""
    bounds = np.array([-(-(k << 64) // BINS) for k in range(BINS)], np.uint64)
    order = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1)
    return bounds, np.argsort(order, axis=1).astype(np.int16)


def signature(elements: np.ndarray) -> np.ndarray:
    """The least element of each bin; an empty bin has that of the first filled bin in its order.  ``elements`` are sorted, one at least."""
    bounds, place = _bins()
    at = np.searchsorted(elements, bounds)
    filled = np.append(at[1:], len(elements)) > at
    out = elements[np.minimum(at, len(elements) - 1)]
    full, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
    if len(empty):
        out[empty] = out[full[place[np.ix_(empty, full)].argmin(1)]]
    return out


_PLACES = mix(np.arange(1, BINS + 1, dtype=np.uint64)) | np.uint64(1)
_BANDS = mix(np.arange(5_001, 5_001 + BINS // BAND, dtype=np.uint64))


def band_keys(elements: np.ndarray) -> np.ndarray:
    """One key for each band of the signature."""
    with np.errstate(over="ignore"):
        return mix((signature(elements) * _PLACES).reshape(-1, BAND).sum(1, dtype=np.uint64) + _BANDS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets):
            sets = sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            with np.errstate(over="ignore"):
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([mix(s ^ np.uint64(0x5BF0_3635)).sum(dtype=np.uint64) for s in sets], np.uint64)
            keys = [band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "keys"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size n, a 128-bit sum of the set, and the keys of its bands."""
    return docs.mapInArrow(_sketch, "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, chunk, a, text), each chunk after its row without a, which has the text of b -> the pairs (a, b) that link."""
    center, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        heads = batch.column(0).to_pylist()
        members = batch.column(2)
        ids, keep = members.to_pylist(), np.zeros(batch.num_rows, bool)
        raw, offsets = text_buffers(batch.column(3))
        for i, j in slices(offsets):
            for k, s in enumerate(sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i):
                if ids[k] is None:
                    center, own = heads[k], s
                elif center == heads[k]:
                    common = len(np.intersect1d(s, own, assume_unique=True))
                    keep[k] = common * DEN >= NUM * (len(s) + len(own) - common) and common > 0
        yield pa.RecordBatch.from_arrays([members.filter(pa.array(keep)), batch.column(0).filter(pa.array(keep))], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that link, by their whole sets, as a stored table.

    The pairs of one b are divided into chunks: a chunk has the text of b once and then those of its members one by one.
    """
    scratch = Scratch(texts.sparkSession)
    pairs = scratch.write(pairs.select("a", "b").distinct(), "pairs")
    wanted = scratch.write(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    own = scratch.write(rows_in(texts, wanted), "texts")
    chunks = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_CHUNK).alias("chunks"))
    dealt = scratch.write(pairs.join(chunks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk")), "dealt")
    members = dealt.join(own.withColumnRenamed("doc_id", "a"), "a").select("b", "chunk", "a", "text")
    centers = dealt.select("b", "chunk").distinct().join(own.withColumnRenamed("doc_id", "b"), "b").select("b", "chunk", F.lit(None).cast("long").alias("a"), "text")
    both = centers.unionByName(members).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.asc_nulls_first("a"))
    found = write_table(both.mapInArrow(_confirm, "a bigint, b bigint").distinct(), "links")
    scratch.drop("pairs", "wanted", "texts", "dealt")
    return found


def _sizes_fit(a: Column, b: Column) -> Column:
    return NUM * F.greatest(a, b) <= DEN * F.least(a, b)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for i, j in slices(offsets):
            keys, counts = np.unique(np.concatenate(sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "m"])


def common_elements(texts: DataFrame, least: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted elements that ``least`` texts or more have, and the powers of two below their counts.

    If there are more than ``most``, those of the highest powers.  It changes which lists the join reads, not its links.
    """
    least, most = COMMON if least is None else least, MOST_COMMON if most is None else most
    counts = texts.select("text").mapInArrow(_whole_sets, "key bigint, m bigint").groupBy("key").agg(F.sum("m").alias("m")).filter(F.col("m") >= least)
    scratch = Scratch(texts.sparkSession)
    table = scratch.write(counts.select("key", F.floor(F.log2("m")).cast("int").alias("power")), "common")
    by_power = {r.power: r["count"] for r in table.groupBy("power").count().collect()}
    total, lowest = 0, 64
    for power in sorted(by_power, reverse=True):
        if total + by_power[power] > most:
            break
        total, lowest = total + by_power[power], power
    rows = table.filter(F.col("power") >= lowest).toArrow()
    scratch.drop("common")
    keys, powers = rows.column("key").to_numpy().view(np.uint64), rows.column("power").to_numpy().astype(np.int8)
    order = np.argsort(keys)
    return keys[order], powers[order]


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def prefix(elements: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first elements of a set, rarer ones first, of which a linked set has at least one."""
    keys, powers = common
    power = np.zeros(len(elements), np.int8)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, elements), len(keys) - 1)
        power = np.where(keys[at] == elements, powers[at], np.int8(0))
    return elements[np.argsort(power, kind="stable")[: prefix_length(len(elements))]]


def _postings(shared_common):
    """(doc_id, component, text) -> (key, rep, component, n, place) of the elements of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared_common.value
        for batch in batches:
            reps, components = (batch.column(k).to_numpy() for k in (0, 1))
            raw, offsets = text_buffers(batch.column(2))
            for i, j in slices(offsets):
                sets = sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                firsts = [prefix(s, common) for s in sets]
                count = [len(x) for x in firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(firsts).view(np.int64)),
                        pa.array(np.repeat(reps[i:j], count)),
                        pa.array(np.repeat(components[i:j], count)),
                        pa.array(np.repeat([len(s) for s in sets], count)),
                        pa.array(np.concatenate([np.arange(x) for x in count])),
                    ],
                    names=["key", "rep", "component", "n", "place"],
                )

    return run


def links_across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) between ``members`` (doc_id, component, a stored table) of different components, all of them."""
    spark = texts.sparkSession
    scratch = Scratch(spark)
    own = scratch.write(rows_in(texts, members.select("doc_id")).join(members, "doc_id").select("doc_id", "component", "text"), "open")
    common = spark.sparkContext.broadcast(common_elements(own))
    posts = scratch.write(own.mapInArrow(_postings(common), "key bigint, rep bigint, component bigint, n bigint, place bigint"), "posts")
    common.destroy()
    mixed = posts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    lists = scratch.write(posts.join(mixed, "key", "left_semi"), "lists")
    p, q = lists.alias("p"), lists.alias("q")
    # Of two linked sets each has its first common element among its first n - overlap + 1.
    overlap = F.ceil((F.col("p.n") + F.col("q.n")) * NUM / (NUM + DEN))
    early = (F.col("p.place") <= F.col("p.n") - overlap) & (F.col("q.place") <= F.col("q.n") - overlap)
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.component") < F.col("q.component")) & _sizes_fit(F.col("p.n"), F.col("q.n")) & early)
    found = confirmed(pairs.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")), own.select("doc_id", "text"))
    scratch.drop("open", "posts", "lists")
    return found


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """vertex, component of all classes (rep, n, keys) that link with another one."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    posts = classes.select("rep", "n", F.explode("keys").alias("key"))
    buckets = posts.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("pivot")).filter("m > 1").select("key", "pivot")
    members = scratch.write(posts.join(buckets, "key"), "members")
    sizes = classes.select(F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"))
    stars = members.filter("rep <> pivot").select("rep", "pivot", "n").distinct().join(sizes, "pivot").filter(_sizes_fit(F.col("n"), F.col("pivot_n")))
    star_links = confirmed(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), texts)
    found = write_table(connected_components(star_links), "found")
    named = members.select("key", "rep").join(found, F.col("rep") == F.col("vertex"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    left = scratch.write(named.join(mixed, "key", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct(), "left")
    later = links_across(left, texts)
    scratch.drop("members", "left")
    if later.isEmpty():
        return found
    return connected_components(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(later))


def _with_component(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` (n, s1, s2, ...) with the component of their class: hot classes, a bounded number, are broadcast, the others shuffled."""
    by = ["n", "s1", "s2"]
    hot = named.filter("hot").select(*by, F.col("component_id").alias("hot_id"))
    marked = rows.join(F.broadcast(hot), by, "left")
    rest = marked.filter("hot_id is null").drop("hot_id").join(named.filter("not hot").select(*by, "component_id"), by, "left")
    return rest.unionByName(marked.filter("hot_id is not null").withColumnRenamed("hot_id", "component_id"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows = write_table(sketches(docs), "sketches")
    some = rows.filter("n > 0 and doc_id is not null")
    classes = scratch.write(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.first("keys").alias("keys")), "classes")
    found = write_table(links(docs, classes), "components")
    hot = F.col("m") * HOT_PART >= F.lit(classes.agg(F.sum("m")).first()[0] or 0)
    named = classes.select("n", "s1", "s2", "rep", hot.alias("hot")).join(found, F.col("rep") == F.col("vertex"), "left")
    named = write_table(named.select("n", "s1", "s2", "hot", F.coalesce("component", "rep").alias("component_id")), "named")
    scratch.drop("classes")
    slim = rows.select("doc_id", "n", "s1", "s2")
    linked = _with_component(slim.filter("n > 0 and doc_id is not null"), named).select("doc_id", "n", "component_id")
    alone = slim.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without those that link with one of a smaller doc_id, directly or by others; rows without doc_id stay."""
    gone = write_table(components(docs).filter("not kept").select("doc_id").distinct(), "gone")
    return rows_not_in(docs, gone)

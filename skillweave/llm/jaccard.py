"""N-gram Jaccard join: a size-aware heavy-light join on word shingles, and the components of its links.

Documents of equal sets form a class, of which one member goes on.  Light sets (of at most a boundary size, chosen by
cost from the sizes that occur) enumerate their fixed-size subsets: two sets of sizes a and b link exactly if they share a
subset of as many elements as their similarity needs, so an equal subset is a link and needs no check.  Heavy sets scan
inverted lists: a set is posted in the lists of its first elements in one global order, as many as any linked set must
share one of.  That order is by hash, but elements of long lists come last; which lists are long is counted over all sets.

Lists are never expanded into all pairs.  First each list links its members with one of them, after an exact check; then
only members that are still in different components are paired, if their sizes and the entry's places in both orders still
allow the similarity, and checked exactly on the whole sets.  Two members of one component need no pair: the answer can't
change.

Words are runs of bytes other than ASCII white space, A-Z as a-z; elements are 64-bit hashes of ``SHINGLE`` words.  A text
of fewer words has one element, all its words.  A null text, or one without words, has no elements and links with
nothing: its component is its own doc_id.  Repeated rows are equal sets.  doc_id is a number (any type that casts to
bigint).  Very long texts are one set each, found in blocks of whole texts.  Other columns are ignored (``one_of_each``
keeps them).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.llm.components import connected_components
from skillweave.llm.shared import Scratch, WordHasher, mix, rows_in, rows_not_in, slices, small_batches, text_buffers, words_of, write_table

SHINGLE = 5
#: Similarity as a fraction: 4/5.
NUM, DEN = 4, 5
LARGEST_LIGHT = 24
#: A posting in a scanned list costs so many emitted subsets: it's joined, and what it finds is checked.
SCAN_COST = 4.0
#: A list longer than this moves its element to the end of the order, as long as at most MOST_LONG elements do.
LONG_LIST, MOST_LONG = 64, 2_000_000


def least_overlap(a: int, b: int) -> int:
    """Common elements that sets of sizes a and b need at least."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def partners(n: int) -> range:
    """Sizes of sets that can link with one of size n."""
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


@cache
def _hasher() -> WordHasher:
    return WordHasher.split_on_spaces()


_TURNS = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def sets_of(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, first = words_of(_hasher(), raw, offsets)
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            total = words[:n] * _TURNS[0]
            for k in range(1, SHINGLE):
                total = total + words[k : k + n] * _TURNS[k]
            whole = mix(total)
        else:
            whole = np.zeros(0, np.uint64)
        out = []
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            count = high - low
            if count >= SHINGLE:
                out.append(np.unique(whole[low : high - SHINGLE + 1]))
            elif count:
                out.append(mix((words[low:high] * _TURNS[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sketch_size(n: int) -> int:
    """How many of a set's lowest hashes are kept: the prefix, and a reserve for elements that move to the end."""
    p = prefix_length(n)
    return n if n <= LARGEST_LIGHT + 8 else min(n, p + p // 4 + 8)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets):
            sets = sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            with np.errstate(over="ignore"):
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([mix(s ^ np.uint64(0x5BF0_3635)).sum(dtype=np.uint64) for s in sets], np.uint64)
            kept = [s[: _sketch_size(len(s))].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(kept, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "sk"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size n, a 128-bit signature of the set, and its lowest hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_sketch, f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, sk array<bigint>")


def subset_cost(n: int, boundary: int) -> int:
    return sum(comb(n, least_overlap(n, b)) for b in partners(n) if b <= boundary and least_overlap(n, b) <= min(n, b))


def choose_boundary(sizes: dict[int, int]) -> int:
    """The largest light size at which subsets and list entries cost least, given how many sets have each size."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= boundary:
                total += count * subset_cost(n, boundary)
            if n > boundary or partners(n)[-1] > boundary:
                total += count * prefix_length(n) * SCAN_COST
        return total

    return min(range(LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _light_keys(elements: np.ndarray, boundary: int) -> list[tuple[int, int]]:
    """(key, smaller size) of every subset that a link within the boundary can rest on."""
    n, out = len(elements), []
    with np.errstate(over="ignore"):
        parts = mix(elements * np.uint64(0xD1342543DE82EF95))
        for b in partners(n):
            c = least_overlap(n, b)
            if b > boundary or c > min(n, b) or b < 1:
                continue
            small, large = min(n, b), max(n, b)
            tag = np.uint64(small * 1_000 + large + 1)
            chosen = np.array(list(combinations(range(n), c)), np.int64)
            keys = mix(mix(parts[chosen].sum(1, dtype=np.uint64)) + tag)
            out += [(k, small) for k in keys.view(np.int64).tolist()]
    return out


def _is_long(elements: np.ndarray, long: np.ndarray) -> np.ndarray:
    if not len(long):
        return np.zeros(len(elements), bool)
    at = np.minimum(np.searchsorted(long, elements), len(long) - 1)
    return long[at] == elements


_FIRST = np.zeros(1, np.int32)


def _posts(long_lists, boundary: int, whole: bool):
    """Rows (rep, n, hashes or text) -> postings (key, rep, n, kind, place in the order).

    kind 0: a scanned list; over 0: a light subset, and the smaller of the sizes it stands for; -1: the hashes at hand
    don't reach, because too many of them are in long lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = long_lists.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                reps = part.column(0).to_numpy()
                if whole:
                    raw, offsets = text_buffers(part.column(1))
                    held = [s for i, j in slices(offsets) for s in sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                    sizes = np.array([len(s) for s in held], np.int64)
                else:
                    sizes = part.column(1).to_numpy()
                    lists = part.column(2)
                    flat = lists.flatten().to_numpy().view(np.uint64)
                    ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
                    held = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                keys, of, kinds, places = [], [], [], []
                for k, (own, n) in enumerate(zip(held, sizes.tolist(), strict=True)):
                    if n == 0:
                        continue
                    if n <= boundary:
                        for key, kind in _light_keys(own, boundary):
                            keys.append(np.array([key], np.int64))
                            of.append((k, 1))
                            kinds.append((kind, 1))
                            places.append(_FIRST)
                    if n > boundary or partners(n)[-1] > boundary:
                        p, last = prefix_length(n), _is_long(own, long)
                        front = own[~last]
                        if len(front) < p and len(own) < n:
                            keys.append(np.zeros(1, np.int64))
                            of.append((k, 1))
                            kinds.append((-1, 1))
                            places.append(_FIRST)
                            continue
                        chosen = front[:p] if len(front) >= p else np.concatenate([front, own[last]])[:p]
                        keys.append(chosen.view(np.int64))
                        of.append((k, p))
                        kinds.append((0, p))
                        places.append(np.arange(p, dtype=np.int32))
                if not keys:
                    continue
                row = np.repeat([k for k, _ in of], [c for _, c in of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(reps[row]), pa.array(sizes[row].astype(np.int32)), pa.array(np.repeat([x for x, _ in kinds], [c for _, c in kinds]).astype(np.int32)), pa.array(np.concatenate(places))],
                    names=["key", "rep", "n", "kind", "place"],
                )

    return run


POSTINGS = "key bigint, rep bigint, n int, kind int, place int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> linked pairs; the set of b is kept from row to row."""
    last_id, last_set = None, None
    for batch in batches:
        a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        raw, offsets = text_buffers(batch.column(2))
        sets = [s for i, j in slices(offsets) for s in sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
        for k in range(len(a_ids)):
            if b_ids[k] != last_id:
                one, at = text_buffers(batch.column(3).slice(k, 1))
                last_id, last_set = b_ids[k], sets_of(one, at)[0]
            common = len(np.intersect1d(sets[k], last_set, assume_unique=True))
            keep[k] = common * DEN >= NUM * (len(sets[k]) + len(last_set) - common) and common > 0
        yield batch.select([0, 1]).filter(pa.array(keep))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    scratch = Scratch(texts.sparkSession)
    pairs = scratch.write(pairs.select("a", "b").distinct(), "pairs")
    wanted = scratch.write(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    own = scratch.write(rows_in(texts, wanted), "texts")
    first = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    found = write_table(both.mapInArrow(_verify, "a bigint, b bigint").distinct(), "links")
    scratch.drop("pairs", "wanted", "texts")
    return found


def _sizes_fit(a: Column, b: Column) -> Column:
    return NUM * F.greatest(a, b) <= DEN * F.least(a, b)


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * NUM / DEN) + 1


def _longest(counts: DataFrame, longest: int, most: int) -> np.ndarray:
    """Sorted keys with a count above ``longest``.  If there are too many to broadcast, only those of the longest lists."""
    table = write_table(counts.filter(F.col("m") > longest), "long")
    by_length = {r.power: r.n for r in table.groupBy(F.floor(F.log2("m")).alias("power")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, max(by_length, default=0) + 1
    for power in sorted(by_length, reverse=True):
        if total + by_length[power] > most:
            break
        total, least = total + by_length[power], power
    found = table.filter(F.floor(F.log2("m")) >= least).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for i, j in slices(offsets):
            sets = sets_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])


def long_lists(classes: DataFrame, texts: DataFrame, boundary: int, longest: int | None = None, most: int = MOST_LONG) -> np.ndarray:
    """Sorted hashes whose lists would be long; which ones are known changes the speed of the join, not its links.

    Lowest hashes are counted for all sets.  Sets that consist of long lists so far as their lowest hashes go are counted
    whole, too, so that what is rare in them comes first.
    """
    longest = LONG_LIST if longest is None else longest
    heavy = classes.filter(F.col("n") > boundary * NUM / DEN)
    first = _longest(heavy.select(F.explode("sk").alias("key")).groupBy("key").agg(F.count("*").alias("m")), longest, most)
    short = _too_long(heavy, first, boundary)
    whole = rows_in(texts, short).select("text").mapInArrow(_whole_sets, "key bigint")
    return np.union1d(first, _longest(whole.groupBy("key").agg(F.count("*").alias("m")), longest, most))


def _too_long(classes: DataFrame, long: np.ndarray, boundary: int) -> DataFrame:
    """doc_id of the classes whose kept hashes don't reach beside the long lists."""
    shared = classes.sparkSession.sparkContext.broadcast(long)
    posts = classes.select("rep", "n", "sk").mapInArrow(_posts(shared, boundary, False), POSTINGS)
    found = write_table(posts.filter("kind = -1").select(F.col("rep").alias("doc_id")), "short")
    shared.destroy()
    return found


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """vertex, component of all classes (rep, n, sk) that link with another one."""
    spark = docs.sparkSession
    sizes = {int(r.n): r["count"] for r in classes.filter(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = spark.sparkContext.broadcast(long_lists(classes, texts, boundary))
    scratch = Scratch(spark)
    posts = scratch.write(classes.select("rep", "n", "sk").mapInArrow(_posts(long, boundary, False), POSTINGS), "posts")
    short = scratch.write(posts.filter("kind = -1").select(F.col("rep").alias("doc_id")), "short")
    more = rows_in(texts, short).select("doc_id", "text").mapInArrow(_posts(long, boundary, True), POSTINGS)
    more = scratch.write(more, "more").filter("kind = 0")  # their subsets, if light, are there already
    long.destroy()
    posts = posts.filter("kind >= 0").unionByName(more)
    pivot = F.min(F.when((F.col("kind") == 0) | (F.col("n") == F.col("kind")), F.col("rep"))).alias("pivot")
    lists = posts.groupBy("key").agg(F.count("*").alias("m"), pivot).filter("m > 1 and pivot is not null")
    members = scratch.write(posts.join(lists.select("key", "pivot"), "key"), "members")
    scratch.drop("posts", "short", "more")
    stars = members.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.max("kind").alias("kind"), F.count("*").alias("c"), F.max("n").alias("n"))
    stars = scratch.write(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "kind", "c", "n"), "stars")
    likely = stars.filter((F.col("kind") == 0) & (3 * F.col("c") >= _prefix(F.col("n"))))
    star_links = _linked(likely, texts).unionByName(stars.filter("kind > 0").select("a", "b"))
    found = write_table(connected_components(star_links), "found")
    scratch.drop("stars")

    scanned = members.filter("kind = 0").select("key", "rep", "n", "place").join(found, F.col("rep") == F.col("vertex"), "left")
    scanned = scanned.select("key", "rep", "n", "place", F.coalesce("component", "rep").alias("component"))
    mixed = scanned.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    open_lists = scratch.write(scanned.join(mixed, "key", "left_semi"), "open")
    scratch.drop("members")
    p, q = open_lists.alias("p"), open_lists.alias("q")
    # Of two linked sets each has its first common element among its first n - overlap + 1.
    overlap = F.ceil((F.col("p.n") + F.col("q.n")) * NUM / (NUM + DEN))
    early = (F.col("p.place") <= F.col("p.n") - overlap) & (F.col("q.place") <= F.col("q.n") - overlap)
    across = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.component") < F.col("q.component")) & _sizes_fit(F.col("p.n"), F.col("q.n")) & early)
    later = _linked(across.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")), texts)
    scratch.drop("open")
    if later.isEmpty():
        return found
    return connected_components(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(later))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = write_table(sketches(docs), "sketches")
    scratch = Scratch(docs.sparkSession)
    classes = scratch.write(rows.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sk").alias("sk")), "classes")
    found = write_table(links(docs, classes), "components")
    named = classes.select("n", "s1", "s2", "rep").join(found, F.col("rep") == F.col("vertex"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the least doc_id.

    Of rows that share a doc_id one stays; rows without a doc_id stay.
    """
    found = write_table(components(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id")), "verdicts")
    gone = write_table(found.filter("doc_id <> component_id").select("doc_id"), "gone")
    kept = rows_not_in(docs, gone)
    repeated = write_table(found.filter("n > 1 and doc_id = component_id").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    return rows_not_in(kept, repeated).unionByName(rows_in(kept, repeated).dropDuplicates(["doc_id"]))

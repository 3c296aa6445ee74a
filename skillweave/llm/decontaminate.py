"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings of all words of the documents and is built once, whatever is searched in it.  It is divided
by documents: each row of the index table is one shard with the lists of its own documents (term -> ascending
positions), so that neither building nor searching it shuffles, and a term that stands in a third of all documents is
spread over all shards.  Global list lengths order each test window's terms from the rarest.  A shard drops the windows
of which it lacks a term, starts from the postings of the rarest one and intersects them with the lists of the next
terms, moved by their offsets: exactly for phrases, within ``slop`` words for proximity.

Words are compared by 64-bit hashes (``shared.WordHasher``).  The test set is searched in blocks of at most
``BLOCK_WORDS`` words, one after the other: only one block at a time is on the driver or broadcast.  Longer items are
divided into runs of words that share no window and leave none out.

Nulls and texts without words have no words and are never hit.  Repeated rows of documents each get their own result,
rows of the test set with one item_id are one item.  Very long texts are a shard of their own.  An empty benchmark
contaminates nothing.  Columns of other names are ignored.  doc_id is a number (any type that casts to bigint).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.shared import Scratch, WordHasher, rows_not_in, slices, small_batches, text_buffers, words_of, write_table

WINDOW = 10
BLOCK_WORDS, RUN_WORDS = 2_000_000, 20_000
#: Bytes of text in a shard, about, and shards that a task holds at once.
SHARD_BYTES, GROUP_SHARDS = 1_000_000, 8
#: Windows, and postings of their rarest terms, that are looked at together in a shard.
WINDOWS_AT_ONCE, POSTINGS_AT_ONCE = 200_000, 1_000_000
INDEX_SCHEMA = "shard string, doc_ids array<bigint>, n_words array<int>, terms array<bigint>, counts array<int>, positions binary"
HIT_SCHEMA = "shard string, ord int, doc_id bigint, n_words bigint, hits array<int>, items array<string>, near_items array<string>"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@cache
def _hasher() -> WordHasher:
    return WordHasher.letters_and_digits()


def _found(ascending: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands, or -1."""
    if not len(ascending):
        return np.full(len(wanted), -1, np.int32)
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1).astype(np.int32)
    return np.where(ascending[at] == wanted, at, np.int32(-1))


class Windows:
    """The different windows of a block of test items, and the items of each.

    A window is ``n`` consecutive words, or all words of a shorter item.  Equal windows are one, so that at a place of a
    document at most one window of each length can match.
    """

    def __init__(self, names: pa.Array, texts: pa.Array, window: int):
        words, first = words_of(_hasher(), *text_buffers(texts))
        self.vocabulary, ids = np.unique(words.view(np.int64), return_inverse=True)
        counts = np.diff(first)
        per_item = np.where(counts == 0, 0, np.maximum(1, counts - window + 1))
        given = np.asarray(names.to_pylist(), object)
        self.names = np.unique(given) if len(given) else given
        item = np.repeat(np.searchsorted(self.names, given) if len(given) else np.zeros(0, np.int64), per_item)
        owner = np.repeat(np.arange(len(counts)), per_item)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(per_item) - per_item, per_item) + first[owner]
        inside = np.arange(window) < np.minimum(counts, window)[owner][:, None]
        at = np.minimum(start[:, None] + np.arange(window), max(len(ids) - 1, 0))
        terms = np.where(inside, ids[at] if len(ids) else 0, -1).astype(np.int32)
        self.terms, which = np.unique(terms, axis=0, return_inverse=True) if len(terms) else (terms, np.zeros(0, np.int64))
        self.length = (self.terms >= 0).sum(1).astype(np.int32)
        held = np.unique(which.ravel() * (len(self.names) + 1) + item)
        self.item = (held % (len(self.names) + 1)).astype(np.int32)
        self.first_item = np.searchsorted(held // (len(self.names) + 1), np.arange(len(self.terms) + 1))
        self.probe = np.zeros(self.terms.shape, np.int8 if window < 128 else np.int32)

    def rarest_first(self, frequency: np.ndarray) -> None:
        """Order each window's offsets by how often their terms occur in the whole corpus; places beyond its end are last."""
        f = np.append(frequency, np.iinfo(np.int64).max)[self.terms]
        self.probe = np.argsort(f, axis=1, kind="stable").astype(self.probe.dtype)


def _lists(kind: pa.DataType, values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _shard_of(doc_ids: pa.Array, texts: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
    """One row of the index: these documents and, for each term, its positions."""
    words, first = words_of(_hasher(), *text_buffers(texts))
    words = words.view(np.int64)
    order = np.argsort(words, kind="stable")
    terms, counts = np.unique(words[order], return_counts=True)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([name]),
            pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())),
            _lists(pa.int32(), np.diff(first), np.array([0, len(doc_ids)])),
            _lists(pa.int64(), terms, np.array([0, len(terms)])),
            _lists(pa.int32(), counts, np.array([0, len(terms)])),
            pa.array([order.astype("<i4").tobytes()], pa.binary()),
        ],
        names=["shard", "doc_ids", "n_words", "terms", "counts", "positions"],
    )


def _index_shards(shard_bytes: int):
    """Arrow batches of documents -> one row per shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, shard_bytes):
                yield from _shard_of(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), f"{part}-{k}")
                k += 1

    return build


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)


class Shard:
    """One row of the index.  A posting's key is the number of its term times the shard's words, plus its position."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.name = batch.column(0)[row].as_py()
        self.doc_ids = batch.column(1)[row].values
        self.first = np.concatenate([[0], np.cumsum(_array(batch, "n_words", row), dtype=np.int64)])
        self.terms, self.counts = _array(batch, "terms", row), _array(batch, "counts", row).astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.positions = np.frombuffer(batch.column(5)[row].as_py(), "<i4").astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms)) * self.first[-1], self.counts) + self.positions

    def has_between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of each term has an entry from low to high."""
        base = term.astype(np.int64) * self.first[-1]
        at = np.searchsorted(self.keys, base + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + high)


def matches(shard: Shard, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, document) of every occurrence inside one document.

    An entry of the rarest term fixes where the window would start; each other term has to stand within ``slop`` words of
    its place.  With 0 that is an exact phrase.
    """
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    number = np.append(_found(shard.terms, windows.vocabulary), np.int32(0))  # the last one is for places beyond a window's end
    for i in range(0, len(windows.terms), WINDOWS_AT_ONCE):
        known = number[windows.terms[i : i + WINDOWS_AT_ONCE]]
        live = np.flatnonzero((known >= 0).all(1))
        rarest = known[live, windows.probe[live + i, 0]]
        total = np.cumsum(shard.counts[rarest])
        a = 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + POSTINGS_AT_ONCE, "right")))
            lens = shard.counts[rarest[a:b]]
            within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            anchor = shard.positions[np.repeat(shard.begin[rarest[a:b]], lens) + within]
            w = np.repeat(live[a:b], lens)
            doc = np.searchsorted(shard.first, anchor, "right") - 1
            start = anchor - windows.probe[w + i, 0]
            for k in range(1, windows.probe.shape[1]):
                if not len(w):
                    break
                offset = windows.probe[w + i, k]
                place = start + offset
                low, high = np.maximum(place - slop, shard.first[doc]), np.minimum(place + slop, shard.first[doc + 1] - 1)
                hit = (offset >= windows.length[w + i]) | shard.has_between(known[w, offset], low, high)
                w, start, doc = w[hit], start[hit], doc[hit]
            found.append((w + i, start, doc))
            a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _items_of(windows: Windows, w: np.ndarray, doc: np.ndarray, docs: int) -> pa.ListArray:
    """The names of the items whose windows were found in each document."""
    many, names = len(windows.terms) + 1, len(windows.names) + 1
    seen = np.unique(doc * many + w)
    of, w = seen // many, seen % many
    counts = windows.first_item[w + 1] - windows.first_item[w]
    total, pairs, i = np.cumsum(counts), np.zeros(0, np.int64), 0
    while i < len(w):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + POSTINGS_AT_ONCE, "right")))
        n = counts[i:j]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        item = windows.item[np.repeat(windows.first_item[w[i:j]], n) + within]
        pairs = np.union1d(pairs, np.repeat(of[i:j], n) * names + item)
        i = j
    return _lists(pa.string(), windows.names[pairs % names], np.searchsorted(pairs // names, np.arange(docs + 1)))


def _search(windows_broadcast, slop: int | None, all_documents: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_broadcast.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                docs = len(shard.doc_ids)
                w, start, doc = matches(shard, windows)
                covered = np.zeros(int(shard.first[-1]) + 1, np.int32)
                np.add.at(covered, start, 1)
                np.add.at(covered, start + windows.length[w], -1)
                hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                cut = np.searchsorted(hit, shard.first)
                near_w, _, near_doc = matches(shard, windows, slop) if slop is not None else (w[:0], w[:0], w[:0])
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.name] * docs, pa.string()),
                        pa.array(np.arange(docs), pa.int32()),
                        shard.doc_ids,
                        pa.array(np.diff(shard.first), pa.int64()),
                        _lists(pa.int32(), hit - np.repeat(shard.first[:-1], np.diff(cut)), cut),
                        _items_of(windows, w, doc, docs),
                        _items_of(windows, near_w, near_doc, docs),
                    ],
                    names=["shard", "ord", "doc_id", "n_words", "hits", "items", "near_items"],
                )
                yield out if all_documents else out.take(pa.array(np.union1d(doc, near_doc), pa.int64()))

    return search


def _lengths(vocabulary_broadcast):
    """The length of each looked-up list, added up by batch of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_broadcast.value
        for batch in batches:
            n = np.zeros(len(vocabulary), np.int64)
            for row in range(batch.num_rows):
                at = _found(vocabulary, _array(batch, "terms", row))
                n[at[at >= 0]] += _array(batch, "counts", row)[at >= 0]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], names=["term", "n"])

    return run


def item_runs(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS, run_words: int = RUN_WORDS) -> tuple[DataFrame, int]:
    """The test items as stored rows (name, text, block) of at most ``run_words`` words, and the number of blocks.

    Runs of an item overlap by a window less a word.  Blocks are dealt by hash; they are made more until none has over
    ``block_words`` words (eight bytes count as a word at least).
    """
    longest = max(window, min(run_words, block_words))
    step = longest - window + 1
    words = F.filter(F.split(F.translate(F.col("text").cast("string"), UPPER, LOWER), BREAKS), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("name"), words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - longest) / step)).cast("int")
    runs = items.select("name", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("w", k * step + 1, longest), " "))).alias("text")).distinct()
    size = F.greatest(F.size(F.split("text", " ")), F.ceil(F.octet_length("text") / 8)).cast("long")
    stored = write_table(runs.select("name", "text", size.alias("size"), F.xxhash64("name", "text").alias("hash")), "runs")
    total = stored.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, ceil(total / block_words))
    while total > block_words:
        most = stored.groupBy(F.pmod("hash", F.lit(blocks))).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).filter("rows > 1").agg(F.max("n")).first()[0] or 0
        if most <= block_words:
            break
        blocks *= 2
    return stored.select("name", "text", F.pmod("hash", F.lit(blocks)).alias("block")), blocks


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all words of ``docs`` (doc_id, text); rows of ``INDEX_SCHEMA``, to be stored."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index_shards(shard_bytes), INDEX_SCHEMA)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its hit word positions, the test items with an exact window and those with a near one.

    ``slop`` asks for proximity matches too: every term of a window within so many words of its place beside the
    window's rarest term.  With ``slop=None`` near_items is empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    index = scratch.write(build_index(docs), "postings", GROUP_SHARDS)
    runs, blocks = item_runs(benchmark, window, block_words)
    parts: list[DataFrame] = []
    for k in [r.block for r in runs.select("block").distinct().orderBy("block").collect()] or [0]:  # a block has millions of words
        block = runs.filter(F.col("block") == k).toArrow()
        windows = Windows(block.column("name").combine_chunks(), block.column("text").combine_chunks(), window)
        vocabulary = spark.sparkContext.broadcast(windows.vocabulary)
        lengths = index.select("terms", "counts").mapInArrow(_lengths(vocabulary), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        vocabulary.destroy()
        frequency = np.zeros(len(windows.vocabulary), np.int64)
        frequency[lengths.column("term").to_numpy()] = lengths.column("n").to_numpy()
        windows.rarest_first(frequency)
        shared = spark.sparkContext.broadcast(windows)
        parts.append(write_table(index.mapInArrow(_search(shared, slop, not parts), HIT_SCHEMA), "found"))
        shared.destroy()
    scratch.drop("postings")
    if len(parts) == 1:
        return parts[0].drop("shard", "ord")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("shard", "ord").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
    )
    return merged.drop("shard", "ord")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and whether it is contaminated."""
    found = find_matches(docs, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any test window; columns unchanged.  Rows that share a doc_id stay or go together."""
    dirty = write_table(contamination(docs, benchmark).filter("contaminated").select("doc_id").distinct(), "dirty")
    return rows_not_in(docs, dirty)


"""Phrase collocation mining: a merged count-min sketch, an exact pass over what survives it, scores, subsumption.

The first pass counts the n-grams of every text in count-min sketches of two rows: one sketch for each of a few tasks,
written in compressed blocks of cells, which are added up by block.  A cell holds at least the count of each n-gram that
falls in it, so an n-gram whose cells both reach ``least`` may be frequent and no other can be.  The second pass hashes
every text again and counts only the n-grams that survive, exactly: in each task by 64-bit keys, over tasks by the words
themselves.  False survivors cost work, never results: exact counts decide.

The sketch grows with the text, up to ``MOST_CELLS`` cells a row (128 MB of counters a task, 16 MB of bits to broadcast).
Beyond some 5 GB of text it fills up, and more rare n-grams reach the second pass.

Texts are split at ``[.,;:!?`` and line ends ``]`` into pieces, pieces at blanks and tabs into words; A-Z count as a-z.
A phrase is 2 to ``longest`` words of one piece, joined by one blank.  Everything is per lang.

A null text is empty, a null lang is ``und``.  Repeated rows count as often as they stand.  A very long text is hashed in
runs of words; its n-grams cross the runs.  An empty table gives an empty result.  Other columns are ignored.  Equal
scores and counts are ordered by phrase, as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.llm.shared import Scratch, WordHasher, mix, slices, small_batches, text_buffers

LONGEST, LEAST, BEST = 5, 100, 2_000
#: Bytes of text for a cell of a row, about; cells of a row at most; cells that are sent and added up together.
CELL_BYTES, MOST_CELLS, BLOCK = 40, 1 << 27, 1 << 16
#: Words whose n-grams are held at once; n-grams that a task of the second pass gathers before it sends them on.
WORDS_AT_ONCE, MOST_HELD = 400_000, 500_000
#: Both passes run in so many tasks for each core: what a task sends on, a sketch or its counts, is as large however little it reads.
TASKS_A_CORE = 2
#: Language names that are broadcast at most, and groups that a language's phrases are ranked in before all are ranked.
MOST_LANGS, RANK_GROUPS = 100_000, 32

_BREAKS = np.zeros(256, bool)
_BREAKS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_TURN = np.uint64(0x9E3779B97F4A7C15)


@cache
def _hasher() -> WordHasher:
    word = ~_BREAKS
    word[[0x20, 0x09]] = False
    return WordHasher(word)


@cache
def _lang_key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


class Pieces:
    """The words of some texts: hash, place, text of each, and how many words its piece still has from it on."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends = _hasher().spans(raw, offsets)
        self.words = _hasher().hashes(raw, self.starts, self.ends)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        n = len(self.starts)
        piece = np.cumsum(_BREAKS[raw])[self.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n)[: len(first)]
        self.left = np.repeat(last, last - first) - np.arange(n)

    def grams(self, langs: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, keys) of the n-grams of 1 to ``longest`` words; ``langs`` has a number for each text."""
        with np.errstate(over="ignore"):
            for low in range(0, len(self.words), WORDS_AT_ONCE):
                at = np.arange(low, min(low + WORDS_AT_ONCE, len(self.words)))
                key = mix(self.words[at] + langs[self.text[at]])
                yield 1, at, key
                for n in range(2, longest + 1):
                    more = self.left[at] >= n
                    at, key = at[more], key[more]
                    key = mix(key * _TURN + self.words[at + n - 1])
                    yield n, at, key


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each key in a row of the sketch: one half of the key, scaled."""
    half = keys >> np.uint64(32) if row == 0 else keys & np.uint64(0xFFFFFFFF)
    return (half * np.uint64(cells) >> np.uint64(32)).astype(np.uint32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, offsets, languages) of runs of whole texts."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        langs = batch.column(1).to_pylist()
        for i, j in slices(offsets):
            yield raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], langs[i:j]


def _keys_of(langs: list[str]) -> np.ndarray:
    return np.array([_lang_key(x) for x in langs], np.uint64)


def _sketch(cells: int, longest: int, least: int):
    """Arrow batches of (text, lang) -> the blocks of this task's sketch: sketch row, block, counters."""
    kind = np.min_scalar_type(max(least, 255))  # counters stop at the largest value of their type, which is enough
    top = np.iinfo(kind).max

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(cells, kind) for _ in range(2)]
        for raw, offsets, langs in _texts(batches):
            pieces, numbers = Pieces(raw, offsets), _keys_of(langs)
            for _, _, keys in pieces.grams(numbers, longest):
                for row, table in enumerate(rows):
                    hit = np.sort(_cells(keys, row, cells))
                    first = np.flatnonzero(np.append(True, hit[1:] != hit[:-1])[: len(hit)])
                    cell, seen = hit[first], np.diff(np.append(first, len(hit)))
                    table[cell] = np.minimum(table[cell] + seen, top).astype(kind)
        for row, table in enumerate(rows):
            for at in range(0, cells, BLOCK):
                part = table[at : at + BLOCK]
                if part.any():
                    body = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([at // BLOCK], pa.int32()), pa.array([body], pa.binary())], names=["row", "block", "counters"])

    return build


def _merge(least: int):
    """Blocks, equal ones one after the other -> the bits of the cells whose sums reach ``least``."""
    kind = np.min_scalar_type(max(least, 255))

    def bits(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        body = np.packbits(total >= least).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([body], pa.binary())], names=["row", "block", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for row, block, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (row, block) != at:
                    if at is not None:
                        yield bits(at, total)
                    at, total = (row, block), np.zeros(BLOCK, np.int64)
                part = np.frombuffer(pa.decompress(body, BLOCK * kind.itemsize, codec="zstd", asbytes=True), kind)
                total[: len(part)] += part
        if at is not None:
            yield bits(at, total)

    return add


def sketch_cells(docs: DataFrame) -> int:
    """Cells of a row: whole blocks, in proportion to the bytes of all texts, up to ``MOST_CELLS``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, -(-(size // CELL_BYTES + 1) // BLOCK) * BLOCK)


def _few_tasks(docs: DataFrame) -> DataFrame:
    return docs.coalesce(max(1, TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism))


def frequent_cells(docs: DataFrame, cells: int, longest: int = LONGEST, least: int = LEAST) -> list[np.ndarray]:
    """For each row of the merged sketch, a bit for each of ``cells`` (whole blocks): whether it counts ``least`` n-grams or more."""
    blocks = _few_tasks(docs).mapInArrow(_sketch(cells, longest, least), "row int, block int, counters binary")
    merged = blocks.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merge(least), "row int, block int, bits binary")
    out = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    for row, block, body in zip(*(merged.toArrow().column(k).to_pylist() for k in range(3)), strict=True):  # at most 2 * MOST_CELLS / 8 bytes
        part = np.frombuffer(body, np.uint8)
        out[row][block * BLOCK // 8 : block * BLOCK // 8 + len(part)] = part
    return out


def _phrase(raw: np.ndarray, pieces: Pieces, at: int, n: int) -> str:
    words = [raw[a:b].tobytes() for a, b in zip(pieces.starts[at : at + n].tolist(), pieces.ends[at : at + n].tolist(), strict=True)]
    return b" ".join(words).lower().decode()


class _Held:
    """Exact counts of a task's surviving n-grams, by key; the words are taken from the first occurrence."""

    def __init__(self) -> None:
        self.keys, self.counts, self.facts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, fact) -> None:
        """``keys`` are sorted and differ; ``fact(k)`` gives lang, number of words and phrase of the k-th."""
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        self.counts[place[known]] += counts[known]
        new = np.flatnonzero(~known)
        facts = np.empty(len(new), object)
        facts[:] = [fact(k) for k in new.tolist()]
        self.keys = np.insert(self.keys, place[new], keys[new])
        self.counts = np.insert(self.counts, place[new], counts[new])
        self.facts = np.insert(self.facts, place[new], facts)

    def batch(self) -> pa.RecordBatch:
        langs, sizes, phrases = zip(*self.facts.tolist(), strict=True) if len(self.facts) else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(self.counts)], names=["lang", "words", "phrase", "n"])


def _has(bits: list[np.ndarray], keys: np.ndarray, cells: int) -> np.ndarray:
    """Indices of the keys whose cells are frequent in both rows."""
    live = np.arange(len(keys))
    for row, table in enumerate(bits):
        cell = _cells(keys[live], row, cells)
        live = live[(table[cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1]
    return live


def _survivors(shared_bits, cells: int, longest: int):
    """Arrow batches of (text, lang) -> (lang, words, phrase, n): exact counts of survivors, and of all words as ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, totals = shared_bits.value, _Held(), {}
        for raw, offsets, langs in _texts(batches):
            pieces, numbers = Pieces(raw, offsets), _keys_of(langs)
            for k, n in enumerate(np.bincount(pieces.text, minlength=len(langs)).tolist()):
                totals[langs[k]] = totals.get(langs[k], 0) + n
            found = []
            for n, at, keys in pieces.grams(numbers, longest):
                live = _has(bits, keys, cells)
                found.append((np.full(len(live), n, np.int32), at[live], keys[live]))
                if n == longest:
                    sizes, at, keys = (np.concatenate(x) for x in zip(*found, strict=True))
                    found = []
                    one, first, counts = np.unique(keys, return_index=True, return_counts=True)
                    sizes, at = sizes[first].tolist(), at[first].tolist()
                    held.add(one, counts, lambda k, s=sizes, a=at: (langs[pieces.text[a[k]]], s[k], _phrase(raw, pieces, a[k], s[k])))
                    if len(held.keys) > MOST_HELD:
                        yield held.batch()
                        held = _Held()
        yield held.batch()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array([""] * len(totals)), pa.array(totals.values(), pa.int64())], names=["lang", "words", "phrase", "n"])

    return count


def frequent_ngrams(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cells: int | None = None) -> DataFrame:
    """lang, words, phrase, n of every n-gram of 1 to ``longest`` words that occurs ``least`` times in a language.

    A row with no words, phrase '' and all words of the language as n comes with each language.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    cells = -(-(cells or sketch_cells(texts)) // BLOCK) * BLOCK
    bits = spark.sparkContext.broadcast(frequent_cells(texts, cells, longest, least))
    found = _few_tasks(texts).mapInArrow(_survivors(bits, cells, longest), "lang string, words int, phrase string, n bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("words") == 0) | (F.col("n") >= least))


def _exact(name: str):
    return F.col(name).cast("decimal(16,0)")


def scored(counted: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of the phrases of two words and more, cut where they score lowest.

    Products are decimals of up to 38 digits: counts of up to 16 digits are exact.
    """
    totals = counted.filter("words = 0").select("lang", F.col("n").alias("total"))
    if totals.count() <= MOST_LANGS:
        totals = F.broadcast(totals)
    parts = counted.filter("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    w = F.split("phrase", " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(w, k + 1, F.col("words") - k), " ").alias("tail")),
    )
    cut = counted.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "words", "phrase", "a", "cut.*")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    parted = both.select("lang", "words", "phrase", "a", "k", "l", "r", F.col("total").alias("n"), (F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("total")).alias("over"), (_exact("l") * _exact("r")).alias("under"))
    parted = parted.withColumn("score", F.expr("over div under"))
    best = parted.groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best"))
    return best.select("lang", "words", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def not_subsumed(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases (lang, words, phrase, a, ...) without those inside a longer one with 100 * its a >= percent * a.

    What lies between a phrase and such a longer one is at least as frequent as the longer one.  So it is enough to look at
    phrases of one word more.
    """
    longer = phrases.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = F.array(F.array_join(F.slice("w", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("words") - 1), " "))
    around = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = phrases.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a")))
    return kept.select(phrases.columns)


def best_of_each(phrases: DataFrame, best: int) -> DataFrame:
    """Each language's first ``best`` phrases with their rank; ranked in groups first, so that no task gets all of them."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    inside = Window.partitionBy("lang", "part").orderBy(*order)
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= best)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = 100, best: int = BEST, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each language of ``docs`` (text, lang)."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(frequent_ngrams(docs, longest, least, cells), "ngrams")
    phrases = scratch.write(scored(counted), "phrases")
    scratch.drop("ngrams")
    return best_of_each(not_subsumed(phrases, percent), best)

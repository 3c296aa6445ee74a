"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a whole text in lower case and their first letters (stems), hashed.  Terms that say
something about the label (a likelihood-ratio test on the training rows) are kept; the machine gives each a weight and a
vector, and a pair of terms that stand together in a text adds the product of their vectors: an insult beside a group's
name weighs more than both alone.

Training rows are labelled documents of which ``crc32(doc_id) mod 5`` is not 0, at most ``MOST_ROWS`` of each label,
those with the lowest hashes of their doc_id.  The fit on that bounded sample runs on the driver; scoring runs on all
documents with a broadcast of at most ``MOST_TERMS`` terms.

A null or empty text has no terms and gets the score of the machine's bias.  Without any label, or with one label only,
no term is kept and the score is the smoothed share of toxic rows.  Repeated rows get equal scores; of several labels of
one doc_id the highest counts.  Very long texts are scored whole, in time and memory in proportion to their length.  Other
columns are ignored (``clean`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.chunks import ArrayStore, chunk_codes
from skillweave.llm.shared import slices, small_batches, text_buffers

MOST_ROWS = 8_000
MOST_TERMS = 4_096
BITS = 20
STEMS = (4, 5, 6)
LEAST_EVIDENCE = 16.0
FACTORS, STEPS, RATE, DECAY = 8, 250, 0.05, 2e-4
TRIM = ".,;:!?\"'()[]{}#*$%&|<>«»„“”-_"
SLICE_BYTES = 4_000_000


def terms_of(token: str) -> list[int]:
    """Hashed terms of one token of a lower-case text."""
    word = token.strip(TRIM)
    if not word:
        return []
    found = [zlib.crc32(b"w" + word.encode("utf-8", "replace"))]
    for n in STEMS:
        if len(word) >= n:
            found.append(zlib.crc32(b"s" + word[:n].encode("utf-8", "replace")))
    return [x & ((1 << BITS) - 1) for x in found]


class TermStore:
    """The distinct terms of whole texts; what a chunk of text gives is kept while there is room."""

    def __init__(self, index: np.ndarray | None = None):
        """``index``: hashed term -> its number in a model, or -1; without it terms are hashes."""
        self.index = index
        self.store = ArrayStore(self._learn)

    def _learn(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [[x for token in k.decode("utf-8", "replace").lower().split() for x in terms_of(token)] for k in keys]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        terms = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        if self.index is None:
            return terms, sizes
        terms, row = self.index[terms], np.repeat(np.arange(len(keys)), sizes)
        return terms[terms >= 0], np.bincount(row[terms >= 0], minlength=len(keys))

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rising distinct terms of all texts end to end, and each one's text."""
        keys, codes, first = chunk_codes(raw, offsets)
        flat, begin = self.store.gather(keys, codes)
        row = np.repeat(np.arange(len(first) - 1), np.diff(begin[first]))
        both = np.unique((row << BITS) | flat)
        return (both & ((1 << BITS) - 1)).astype(np.int32), both >> BITS


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the products of their vectors)."""

    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def index(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def scores(self, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts whose terms' numbers are ``flat``, in rows ``row``."""
        return 1 / (1 + np.exp(-np.clip(self._raw(flat, row, n)[0], -500, 500)))

    def _raw(self, flat: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(n, self.bias) + np.bincount(row, self.weights[flat], n)
        sums = np.stack([np.bincount(row, self.vectors[flat, f], n) for f in range(self.vectors.shape[1])], 1)
        squares = np.bincount(row, (self.vectors[flat] ** 2).sum(1), n)
        return out + 0.5 * ((sums**2).sum(1) - squares), sums


def _evidence(present_toxic: np.ndarray, toxic: int, present_clean: np.ndarray, clean: int) -> np.ndarray:
    """Likelihood-ratio statistic of each term's 2 x 2 table."""
    total, present = toxic + clean, present_toxic + present_clean
    out = np.zeros(len(present))
    for seen, rows, columns in (
        (present_toxic, toxic, present),
        (present_clean, clean, present),
        (toxic - present_toxic, toxic, total - present),
        (clean - present_clean, clean, total - present),
    ):
        expected = np.maximum(rows * columns / total, 1e-9)
        out += 2 * seen * np.log(np.maximum(seen, 1e-9) / expected)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted to rows of hashed terms by full-batch Adam on the logistic loss, both labels weighing the same."""
    toxic, clean = int(labels.sum()), int((1 - labels).sum())
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 1e-6
        return Machine(float(np.log(share / (1 - share))))
    size = 1 << BITS
    on_toxic = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), minlength=size)
    on_clean = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if not y]), minlength=size)
    score = _evidence(on_toxic, toxic, on_clean, clean)
    order = np.argsort(-score, kind="stable")[:MOST_TERMS]
    terms = np.sort(order[score[order] >= LEAST_EVIDENCE]).astype(np.int32)
    rng = np.random.default_rng(seed)
    model = Machine(-2.0, terms, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), FACTORS)))
    index = model.index()
    kept = [index[r][index[r] >= 0] for r in rows]
    flat, row, n = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(k) for k in kept]), len(kept)
    share = np.where(labels == 1, 0.5 / toxic, 0.5 / clean)
    bias = np.array([model.bias])
    state = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in (("b", bias), ("w", model.weights), ("v", model.vectors))}
    for step in range(1, STEPS + 1):
        model.bias = float(bias[0])
        raw, sums = model._raw(flat, row, n)
        error = share * (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - labels)
        per = error[row]
        gw = np.bincount(flat, per, len(terms)) + DECAY * model.weights
        own = np.bincount(flat, per, len(terms))[:, None] * model.vectors
        gv = np.stack([np.bincount(flat, per * sums[row, f], len(terms)) for f in range(FACTORS)], 1) - own + DECAY * model.vectors
        for name, x, g in (("b", bias, np.array([error.sum()])), ("w", model.weights, gw), ("v", model.vectors, gv)):
            m, v = state[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.bias = float(bias[0])
    return model


def held_out(doc_id):
    """Whether a document's label must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store = TermStore()
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets, SLICE_BYTES):
            flat, row = store.rows(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cuts = np.searchsorted(row, np.arange(j - i + 1)).tolist()
            found = [flat[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.binary())], names=["toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """Fit on at most ``most_rows`` labelled rows of each label that are not held out."""
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for label in (1, 0):
        own = marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("toxic", "text")  # at most most_rows a label
    rows = texts.mapInArrow(_hash_rows, "toxic int, terms binary").toArrow().to_pydict()
    order = sorted(range(len(rows["toxic"])), key=lambda i: (rows["toxic"][i], rows["terms"][i]))
    return fit([np.frombuffer(rows["terms"][i], "<i4") for i in order], np.array([rows["toxic"][i] for i in order], np.int64))


def _scorer(machine: Machine):
    """Arrow batches of texts -> arrays of their scores."""

    def run(columns: Iterator[pa.Array]) -> Iterator[np.ndarray]:
        store = TermStore(machine.index())
        for column in columns:
            raw, offsets = text_buffers(column)
            parts = [machine.scores(*store.rows(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i) for i, j in slices(offsets, SLICE_BYTES)]
            yield np.concatenate(parts) if parts else np.zeros(0)

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    small_batches(docs.sparkSession)
    of = _scorer(machine)  # at most MOST_TERMS terms

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in of(texts):
            yield pa.array(found, pa.float64())

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(F.col("text").cast("string")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, columns unchanged.  Only texts go to Python, only verdicts come back."""
    of = _scorer(train(docs, labels))

    @F.arrow_udf("boolean")
    def fine(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in of(texts):
            yield pa.array(found < 0.5, pa.bool_())

    return docs.filter(fine(F.col("text").cast("string")))

"""Hard-negative mining: ball trees in every partition, searched by branch and bound for scores inside a window.

The rows of each partition are planted as trees, stored once: a node is a ball around the mean of its rows, which it halves
along the line between two far ones, down to leaves.  The inner product of an anchor with anything in a ball lies between
that with its centre less and plus the anchor's length times the radius.  A node is left out if that range misses the
score window, if all its labels are the wrong ones, or if its upper end is strictly beneath the current kth score; leaves
are read from the best upper end on.  Scores are whole numbers, and exact: a bound only ever decides what isn't read.

The anchors are a stated set of queries, searched in blocks: one block at a time is broadcast.  A task keeps the k best
rows of each query over all its trees, and what the tasks keep is ranked by Spark.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.  Vectors of unequal
lengths are compared as if the shorter one went on with zeros; an empty one scores 0.  Equal scores are ordered by
vec_id.  Repeated rows take a place each, an anchor that stands twice asks once (as its least row), and no row is a
partner of an anchor of its own vec_id.  Scores that don't fit 64 bits are an error.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.shared import Scratch, small_batches, write_table

ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative scores from LOW to HIGH percent of the positive.
LOW, HIGH = 30, 90
#: Components in a tree and in a block of anchors, about; rows of a leaf; bounds that are worked out together.
TREE_VALUES, BLOCK_VALUES, LEAF, PAIRS_AT_ONCE = 1 << 19, 1 << 17, 64, 50_000
#: How many trees of the stored table a task holds at once.
GROUP_TREES = 4
#: A query reads its best leaf, then those up to these places, then the rest, and drops what fell beneath its kth score.
ROUNDS = (1, 4, 16)
NONE = np.iinfo(np.int64).min
TREE_SCHEMA = "dims int, vec_ids array<bigint>, labels array<int>, points binary, centers binary, radii array<double>"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q of the rows that take part: labels as mined, components as whole numbers."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(256 * c.cast("double")).cast("long")).alias("q"))


def _padded(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter lists end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices: in doubles where no sum can pass 2**53."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dims
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.array((a.astype(object) @ b.T.astype(object)).tolist(), np.int64).reshape(len(a), len(b))


def depth_of(n: int) -> int:
    """Levels below the root of a tree of n rows, all leaves being on the last one."""
    depth = 0
    while n > LEAF << depth:
        depth += 1
    return depth


def ranges(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last-but-one row of the nodes of each level; a node's halves are 2i and 2i + 1 on the next level."""
    begin, end = np.zeros(1, np.int64), np.full(1, n, np.int64)
    out = [(begin, end)]
    for _ in range(depth_of(n)):
        middle = (begin + end) // 2
        begin, end = np.ravel(np.column_stack([begin, middle])), np.ravel(np.column_stack([middle, end]))
        out.append((begin, end))
    return out


def plant(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows in the tree, and centre and radius of its nodes, level by level."""
    order, x = np.arange(len(points)), points.astype(float)
    levels = ranges(len(points))
    for begin, end in levels[:-1]:
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = x[order[a:b]]
            one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            along = own @ (other - one)
            order[a:b] = order[a:b][np.argpartition(along, (b - a) // 2)] if b - a > 1 else order[a:b]
    centers, radii = [], []
    for begin, end in levels:
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = x[order[a:b]]
            centers.append(own.mean(0))
            radii.append(np.sqrt(((own - centers[-1]) ** 2).sum(1).max()))
    return order, np.array(centers), np.array(radii)


def _tree_row(ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
    order, centers, radii = plant(points)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([points.shape[1]], pa.int32()),
            pa.array([ids[order]], pa.list_(pa.int64())),
            pa.array([labels[order]], pa.list_(pa.int32())),
            pa.array([points[order].astype("<i8").tobytes()], pa.binary()),
            pa.array([centers.astype("<f8").tobytes()], pa.binary()),
            pa.array([radii], pa.list_(pa.float64())),
        ],
        names=["dims", "vec_ids", "labels", "points", "centers", "radii"],
    )


def _plant_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, values = [], 0
    for batch in batches:
        points = _padded(batch.column(2))
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), points))
        values += points.size + len(points)
        if values >= TREE_VALUES:
            yield _joined(held)
            held, values = [], 0
    if sum(len(x[0]) for x in held):
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    dims = max(x[2].shape[1] for x in held)
    points = np.concatenate([np.pad(x[2], ((0, 0), (0, dims - x[2].shape[1]))) for x in held])
    return _tree_row(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), points)


class Tree:
    """One row of the stored trees."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        dims = batch.column(0)[row].as_py()
        self.ids, self.labels = (batch.column(k)[row].values.to_numpy() for k in (1, 2))
        n = len(self.ids)
        self.points = np.frombuffer(batch.column(3)[row].as_py(), "<i8").reshape(n, dims)
        centers = np.frombuffer(batch.column(4)[row].as_py(), "<f8").reshape(-1, dims)
        radii = batch.column(5)[row].values.to_numpy()
        self.levels, at = [], 0
        for begin, end in ranges(n):
            low, high = (f.reduceat(self.labels, begin) for f in (np.minimum, np.maximum))
            self.levels.append((begin, end, centers[at : at + len(begin)], radii[at : at + len(begin)], low, high))
            at += len(begin)


@dataclass
class Queries:
    """Anchors, and what is sought for each query: ``of`` is its anchor; rows of its label or of others, in a window."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.sqrt((self.points.astype(float) ** 2).sum(1))


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), NONE), np.full((queries, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(q)
        every = np.concatenate([np.repeat(some, self.k), q]), np.concatenate([self.scores[some].ravel(), scores]), np.concatenate([self.ids[some].ravel(), ids])
        order = np.lexsort((every[2], -np.maximum(every[1], NONE + 1), every[0]))
        q, scores, ids = (x[order] for x in every)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.scores[q[kept], place[kept]], self.ids[q[kept], place[kept]] = scores[kept], ids[kept]


def _bounds(queries: Queries, tree_level, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above of the scores that each query can have in its node, wide enough for rounding."""
    _, _, centers, radii, _, _ = tree_level
    dims = min(centers.shape[1], queries.points.shape[1])
    middle = np.empty(len(q))
    for i in range(0, len(q), PAIRS_AT_ONCE):
        part = slice(i, i + PAIRS_AT_ONCE)
        middle[part] = np.einsum("ij,ij->i", queries.points[queries.of[q[part]], :dims].astype(float), centers[node[part], :dims])
    length = queries.lengths[queries.of[q]]
    reach = length * radii[node] * (1 + 1e-9) + 1e-9 * length * np.sqrt((centers**2).sum(1))[node] + 1e-6
    return middle - reach, middle + reach


def search(tree: Tree, queries: Queries, best: Best) -> int:
    """Bring ``best`` up to date with the rows of ``tree``; how many scores were worked out."""
    q, node = np.arange(len(queries.of)), np.zeros(len(queries.of), np.int64)
    for depth, level in enumerate(tree.levels):
        if depth:
            q, node = np.repeat(q, 2), np.ravel(np.column_stack([2 * node, 2 * node + 1]))
        below, above = _bounds(queries, level, q, node)
        label, least, greatest = queries.labels[queries.of[q]], level[4][node], level[5][node]
        fits = (least <= label) & (label <= greatest) if queries.same else (least != label) | (greatest != label)
        live = fits & (above >= queries.low[q]) & (below <= queries.high[q]) & (above >= best.kth()[q])
        q, node, above = q[live], node[live], above[live]
    begin, end = tree.levels[-1][:2]
    order = np.lexsort((-above, q))
    q, node, above = q[order], node[order], above[order]
    place, read, done = np.arange(len(q)) - np.searchsorted(q, q), 0, 0
    for upto in (*ROUNDS, len(begin)):
        now = np.flatnonzero((place >= done) & (place < upto) & (above >= best.kth()[q]))
        now = now[np.argsort(node[now], kind="stable")]
        cut = np.flatnonzero(np.append(True, node[now][1:] != node[now][:-1])[: len(now)])
        found = []
        for pairs in np.split(now, cut[1:]) if len(now) else []:
            rows, leaf = q[pairs], node[pairs[0]]
            inside = slice(begin[leaf], end[leaf])
            anchors, which = np.unique(queries.of[rows], return_inverse=True)
            scores = _products(queries.points[anchors], tree.points[inside])[which]
            read += scores.size
            of = queries.of[rows][:, None]
            wanted = (tree.labels[inside] == queries.labels[of]) == queries.same
            wanted &= (tree.ids[inside] != queries.ids[of]) & (scores >= np.maximum(queries.low, best.kth())[rows][:, None]) & (scores <= queries.high[rows][:, None])
            r, c = np.nonzero(wanted)
            found.append((rows[r], scores[r, c], tree.ids[inside][c]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        done = upto
    return read


def _search_all(shared):
    """Rows of trees -> (query, place, score, vec_id): the best rows of each query in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(len(queries.of), queries.k)
        for batch in batches:
            for row in range(batch.num_rows):
                search(Tree(batch, row), queries, best)
        q, place = np.nonzero(best.scores > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best.scores[q, place]), pa.array(best.ids[q, place])], names=["query", "score", "vec_id"])

    return run


def best_rows(trees: DataFrame, queries: Queries) -> DataFrame:
    """query, rank, score, vec_id: the first k rows of each query, as a stored table."""
    shared = trees.sparkSession.sparkContext.broadcast(queries)
    found = trees.mapInArrow(_search_all(shared), "query bigint, score bigint, vec_id bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kept = write_table(found.withColumn("rank", rank).filter(F.col("rank") <= queries.k), "best")
    shared.destroy()
    return kept


def _windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole score between LOW and HIGH percent of each positive's."""
    exact = scores.tolist()
    return np.array([-(-LOW * s // 100) for s in exact], np.int64), np.array([HIGH * s // 100 for s in exact], np.int64)


def _block(trees: DataFrame, anchors: pa.Table, positives: int, negatives: int) -> DataFrame:
    ids, labels, points = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _padded(anchors.column("q"))
    every = np.arange(len(ids))
    limits = np.iinfo(np.int64)
    first = Queries(ids, labels, points, every, np.full(len(ids), limits.min), np.full(len(ids), limits.max), True, positives)
    near = best_rows(trees, first).orderBy("query", "rank").toArrow()  # ``positives`` rows for each anchor of a block
    of, score, positive = (near.column(c).to_numpy() for c in ("query", "score", "vec_id"))
    found = best_rows(trees, Queries(ids, labels, points, of, *_windows(score), False, negatives))
    asked = pa.table({"query": np.arange(len(of)), "anchor_id": ids[of], "positive_id": positive, "positive_score": score})
    asked = trees.sparkSession.createDataFrame(asked)
    return found.join(F.broadcast(asked), "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _is_anchor(vec_id: Column) -> Column:
    return vec_id % ANCHOR_EVERY == 0


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``embeddings`` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = vectors(embeddings)
    trees = scratch.write(rows.mapInArrow(_plant_all, TREE_SCHEMA), "trees", GROUP_TREES)
    anchors = rows.filter(_is_anchor(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("least")).select("vec_id", "least.*")
    anchors = scratch.write(anchors.withColumn("hash", F.xxhash64("vec_id")), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.sum(F.size("q") + 1).alias("values")).first()
    blocks = max(1, ceil((size["values"] or 0) / block_values))
    parts = []
    for k in range(blocks):
        block = anchors.filter(F.pmod("hash", F.lit(blocks)) == k).toArrow()
        if block.num_rows or not parts:
            parts.append(_block(trees, block, positives, negatives))
    scratch.drop("trees", "anchors")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

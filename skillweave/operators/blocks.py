"""All pairs of two tables of weighted sets over a small vocabulary: rows are packed into blocks, blocks meet in tiles dealt to tasks.

A block is some thousand rows, kept as the places and weights of their items; a task turns two of them at a time into
matrices, whatever the number of rows.  A tile is a run of blocks of one side and a run of the other: a block is sent once for
all that it meets there, and what a tile finds about its rows can be added up before it leaves the task.  ``vocabulary``
says whether the items are few enough; where they aren't, pairs are found by joins on rare items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.session import materialise

#: Items beyond which rows are not packed; rows of a block at least and at most; rows of a product at a time.
MOST_ITEMS, LEAST_ROWS, MOST_ROWS, SLICE = 2_048, 256, 8_192, 256
#: Cells of a block's matrix at most, while it has ``LEAST_ROWS`` rows.
CELLS = 1 << 22
#: Rows are cut into about so many blocks, while that keeps within the bounds.
AIM = 48
TASKS_A_CORE = 4
#: Bytes of the blocks that a task holds of one side of a tile, about.
TILE_BYTES = 64 << 20


def vocabulary(items: DataFrame) -> np.ndarray | None:
    """The sorted distinct values of a column of longs, or None if there are more than ``MOST_ITEMS``."""
    found = [r[0] for r in items.distinct().limit(MOST_ITEMS + 1).collect()]
    return None if len(found) > MOST_ITEMS else np.sort(np.array(found, "<i8"))


def pack(rows: DataFrame, words: np.ndarray, order: list[str], least_rows: int | None = None) -> DataFrame:
    """Blocks of ``rows`` (columns, items array<long>, weights array<double>) in ``order``, stored.

    Columns: block (numbers in that order), low and high (of the first column of ``order``, a number), bytes, one array for
    each column of ``rows`` but items and weights, and the rows' items: lengths, places in ``words``, weights (none if all are 1).
    """
    held = [c for c in rows.columns if c not in ("items", "weights")]
    n = rows.count()
    size = min(MOST_ROWS, max(LEAST_ROWS if least_rows is None else least_rows, n // AIM), max(LEAST_ROWS, CELLS // max(1, len(words))))
    kinds = [f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, waiting, count = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            items, weights = table["items"].combine_chunks(), table["weights"].combine_chunks()
            lengths = np.diff(items.offsets.to_numpy()).astype("<i4")
            values = weights.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            bits = [lengths.tobytes(), np.searchsorted(words, items.flatten().to_numpy()).astype("<u2").tobytes(), b"" if (values == 1).all() else values.tobytes()]
            range_of = table[order[0]].to_numpy()
            columns = [pa.array([x], t) for x, t in (((part << 32) + k, pa.int64()), (range_of.min(), pa.float64()), (range_of.max(), pa.float64()), (table.nbytes, pa.int64()))]
            for c in held:
                own = table[c].combine_chunks()
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
            columns += [pa.array([x], pa.binary()) for x in bits]
            return pa.RecordBatch.from_arrays(columns, ["block", "low", "high", "bytes", *held, "lengths", "places", "shares"])

        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            while count >= size:
                table = pa.Table.from_batches(waiting)
                yield block(table.slice(0, size))
                waiting, k, count = table.slice(size).to_batches(), k + 1, count - size
        if count:
            yield block(pa.Table.from_batches(waiting))

    ranged = rows.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    schema = ["block long", "low double", "high double", "bytes long", *kinds, "lengths binary", "places binary", "shares binary"]
    return materialise(ranged.mapInArrow(run, ", ".join(schema)))


class Block:
    """A block in a task: its columns by name, its rows as a matrix, and ``found``, where work keeps what it adds up."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_words: int):
        self.columns, self.found, self._dense, self.words = {}, {}, {}, n_words
        for name in batch.schema.names:
            value = batch.column(name)
            if pa.types.is_list(value.type) and value[i].is_valid:
                self.columns[name[2:]] = value[i].values
        self.number, self.low, self.high = (batch.column(c)[i].as_py() for c in ("block", "low", "high"))
        lengths, places, shares = (batch.column(c)[i].as_py() for c in ("lengths", "places", "shares"))
        self.lengths, self.places = np.frombuffer(lengths, "<i4"), np.frombuffer(places, "<u2")
        self.shares = np.frombuffer(shares, "<f8") if shares else np.ones(len(self.places))

    def __getitem__(self, column: str) -> pa.Array:
        return self.columns[column]

    def __len__(self) -> int:
        return len(self.lengths)

    def matrix(self, kind: str = "<f8", keep: bool = False) -> np.ndarray:
        if kind in self._dense:
            return self._dense[kind]
        out = np.zeros((len(self), self.words), kind)
        out[np.repeat(np.arange(len(self)), self.lengths), self.places] = self.shares
        if keep:
            self._dense[kind] = out
        return out


def _runs(blocks: list, most: int) -> list[list]:
    """Blocks in order, in about ``most`` runs of at most ``TILE_BYTES``, or one block."""
    out, size, bytes_ = [], max(1, ceil(len(blocks) / max(1, most))), 0
    for b in blocks:
        if not out or len(out[-1]) >= size or bytes_ + b.bytes > TILE_BYTES:
            out.append([])
            bytes_ = 0
        out[-1].append(b)
        bytes_ += b.bytes
    return out


def pairs(
    left: DataFrame,
    right: DataFrame,
    words: np.ndarray,
    work: Callable[[Block, Block], Iterator[list]],
    schema: str,
    fit: Callable[[float, float, float, float], bool] | None = None,
    finish: Callable[[Block], Iterator[list]] | None = None,
    once: bool = False,
) -> DataFrame:
    """What ``work`` yields (lists of columns of ``schema``) for each pair of blocks p of ``left`` and q of ``right`` that ``fit``.

    ``fit`` gets low and high of p, then of q.  ``once`` takes each pair of blocks of one table once.  A task goes through the
    blocks q of its tile, holding those of p; when they have passed, ``finish`` yields what is left to say about each p.
    """
    spark = left.sparkSession
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    sides = [sorted(x.select("block", "low", "high", "bytes").collect()) for x in (left, right)]
    if once:
        runs = [_runs(sides[0], ceil(sqrt(2 * tasks)))] * 2
    else:
        few = min(len(sides[0]), ceil(sqrt(tasks)))
        wide = min(len(sides[1]), ceil(tasks / max(1, few)))
        runs = [_runs(sides[0], ceil(tasks / max(1, wide))), _runs(sides[1], wide)]
    span = lambda run: (min(b.low for b in run), max(b.high for b in run))
    tiles = [(sum(len(r) for r in (p, q)), i, j) for i, p in enumerate(runs[0]) for j, q in enumerate(runs[1]) if not (once and i > j) and (fit is None or fit(*span(p), *span(q)))]
    tiles = [(i, j) for _, i, j in sorted(tiles, reverse=True)]  # the largest first
    sent = []
    for tile, (i, j) in enumerate(tiles):
        sent += [(b.block, tile, 0) for b in runs[0][i]] + [(b.block, tile, 1) for b in runs[1][j]]
    where = F.broadcast(spark.createDataFrame(sent, "block long, tile int, side int"))
    names = ["block", "low", "high", "lengths", "places", "shares"]

    def side(blocks: DataFrame, k: int) -> DataFrame:
        own = [F.col(c).alias("pq"[k] + "_" + c) for c in blocks.columns if c not in (*names, "bytes")]
        return blocks.select(*names, *own).join(where.filter(F.col("side") == k), "block")

    both = side(left, 0).unionByName(side(right, 1), allowMissingColumns=True)
    labels = spark.createDataFrame([], schema).columns
    n_words = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, n_words)
                if batch.column("side")[i].as_py() == 0:
                    held.append(block)
                    continue
                for p in held:
                    if not (once and p.number > block.number) and (fit is None or fit(p.low, p.high, block.low, block.high)):
                        for columns in work(p, block):
                            yield pa.RecordBatch.from_arrays(columns, labels)
        for p in held if finish is not None else ():
            for columns in finish(p):
                yield pa.RecordBatch.from_arrays(columns, labels)

    # A tile is a partition: blocks that are held come first.
    return both.repartitionById(max(1, len(tiles)), "tile").sortWithinPartitions("side", "block").mapInArrow(run, schema)

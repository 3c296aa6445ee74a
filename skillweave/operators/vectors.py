"""Nearest vectors by cosine: a clustered index of blocks, and angles between blocks that say which of them can't matter.

Both sides are packed into blocks of about ``BLOCK_ROWS`` vectors of one group, close ones together: every vector goes to
the nearest of a bounded number of centres.  A block knows its mean direction and the widest angle to it.  By the triangle
inequality no vector of one block is closer to one of another than the angle between their means less both widths.  Each
query block first meets the block next to it; after that only blocks whose bound reaches the least score found there.
Blocks meet in a join, and products are worked out in tasks, so neither side passes the driver.

With ``probes`` each query block meets only so many nearest blocks: approximate, and linear in the queries.

Vectors of zeros have a cosine of 0 with everything.  Null ids, groups or vectors take no part.  A vector isn't its own
neighbour.  Equal scores go to the lesser vec_id.  Repeated index rows are one; a query without another vector in its group
has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions.similarity import dot
from skillweave.session import materialise

BLOCK_ROWS, MOST_CENTRES = 1_024, 1_024
#: Vectors from which centres are drawn, for each centre.
SAMPLE = 8
BLOCK = "block string, grp string, ids array<bigint>, points binary, centre array<double>, width double"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, grp, u: vectors of length one (or zero) of ``vectors`` (vec_id, grp, embedding), each once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.filter("vec_id is not null and grp is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("grp").cast("string").alias("grp"), x.alias("x")).distinct()
    length = F.sqrt(dot(F.col("x"), F.col("x")))
    return rows.withColumn("length", length).select("vec_id", "grp", F.transform("x", lambda v: F.when(F.col("length") > 0, v / F.col("length")).otherwise(F.lit(0.0))).alias("u"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centres_of(vectors: DataFrame, most: int = MOST_CENTRES, rounds: int = 3) -> np.ndarray:
    """Directions that close vectors gather around: k-means of a sample by hash, of ``SAMPLE`` vectors for a centre."""
    n = min(most, max(1, ceil(vectors.count() / BLOCK_ROWS)))
    if n == 1:
        return np.zeros((1, 1))
    sample = vectors.orderBy(F.xxhash64("vec_id", "grp"), "vec_id").select("u").limit(n * SAMPLE).toArrow().column("u").combine_chunks()  # a bounded number of rows
    x = _matrix(sample)
    centres = x[:n]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def _nearest_centre(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            x = _matrix(batch.column(2)) if batch.num_rows else np.zeros((0, centres.shape[1]))
            near = (x @ centres.T).argmax(1) if len(centres) > 1 else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=["vec_id", "grp", "u", "cell"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, grp, rows) -> the block with its mean direction and the widest angle to it (pi if there is a zero vector)."""
    for batch in batches:
        rows = batch.column(2)
        for k in range(batch.num_rows):
            held = rows[k].values
            x = _matrix(held.field("u"))
            mean = x.sum(0)
            mean = mean / max(float(np.linalg.norm(mean)), 1e-12)
            width = float(np.arccos(np.clip(x @ mean, -1, 1)).max(initial=0.0)) if (x**2).sum(1).min(initial=0.0) > 0 else np.pi
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([held.field("vec_id")], pa.list_(pa.int64())), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([mean], pa.list_(pa.float64())), pa.array([width])],
                names=["block", "grp", "ids", "points", "centre", "width"],
            )


def blocks_of(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The packed blocks of unit vectors, stored; large cells are divided by hash."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    placed = materialise(vectors.mapInArrow(_nearest_centre(shared), "vec_id bigint, grp string, u array<double>, cell bigint"))
    shared.destroy()
    parts = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    dealt = placed.join(parts, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    rows = dealt.groupBy("grp", "cell", "part").agg(F.array_sort(F.collect_list(F.struct("vec_id", "u"))).alias("rows"))  # about BLOCK_ROWS of them
    return materialise(rows.select(F.concat_ws("/", "grp", "cell", "part").alias("block"), "grp", "rows").mapInArrow(_pack, BLOCK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles in order, index blocks (no mates) before query blocks -> the best row of each query among its block's mates."""
    tile, held = None, {}
    for batch in batches:
        tiles, blocks, mates = (batch.column(c).to_pylist() for c in (0, 2, 5))
        for k, (own_tile, block) in enumerate(zip(tiles, blocks, strict=True)):
            if own_tile != tile:
                tile, held = own_tile, {}
            ids = batch.column(3)[k].values.to_numpy()
            x = np.frombuffer(batch.column(4)[k].as_buffer(), "<f8").reshape(len(ids), -1)
            if mates[k] is None:
                held[block] = (ids.copy(), x.copy())
                continue
            value, near = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
            for mate in mates[k]:
                others, y = held[mate]
                score = x @ y.T * 100
                score[ids[:, None] == others[None]] = -np.inf
                best = score.argmax(1)  # the first of equal ones, ids being in order
                here, who = score[np.arange(len(ids)), best], others[best]
                better = (here > value) | ((here == value) & (who < near) & np.isfinite(here))
                value, near = np.where(better, here, value), np.where(better, who, near)
            some = np.isfinite(value)
            yield pa.RecordBatch.from_arrays([pa.array([block] * int(some.sum()), pa.string()), pa.array(ids[some]), pa.array(near[some]), pa.array(value[some])], names=["q", "query_id", "vec_id", "score"])


#: Blocks of each side that meet in one tile: a block is sent once for so many blocks that it meets.
RUN = 16


def _runs(blocks: DataFrame) -> DataFrame:
    """block, run: the blocks of a group in runs of ``RUN`` (one row for each block, no points)."""
    return blocks.select("block", F.floor((F.row_number().over(Window.partitionBy("grp").orderBy("block")) - 1) / RUN).alias("run"))


def _met(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """The best row of each query among the pairs of blocks (q, x), by tiles: a run of query blocks and one of index blocks.

    A task holds the index blocks of one tile, and each query block passes them.
    """
    groups = queries.select(F.col("block").alias("q"), "grp")
    runs = [_runs(side).select(F.col("block").alias(name), F.col("run").alias(f"{name}_run")) for side, name in ((queries, "q"), (index, "x"))]
    tiled = pairs.select("q", "x").join(groups, "q").join(runs[0], "q").join(runs[1], "x").select(F.concat_ws("/", "q_run", "x_run", "grp").alias("tile"), "q", "x")
    asking = tiled.groupBy("tile", "q").agg(F.collect_list("x").alias("mates")).join(queries.select(F.col("block").alias("q"), "ids", "points"), "q")
    asked = tiled.select("tile", "x").distinct().join(index.select(F.col("block").alias("x"), "ids", "points"), "x")
    rows = asked.select("tile", F.lit(0).alias("side"), F.col("x").alias("block"), "ids", "points", F.lit(None).cast("array<string>").alias("mates")).unionByName(
        asking.select("tile", F.lit(1).alias("side"), F.col("q").alias("block"), "ids", "points", "mates")
    )
    return rows.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_compare, "q string, query_id bigint, vec_id bigint, score double")


def _bound(cosine: Column, widths: Column) -> Column:
    """The highest cosine times 100 that two blocks allow."""
    return F.cos(F.greatest(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - widths - 1e-7, F.lit(0.0))) * 100


def block_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """q, x, bound, place of all pairs of blocks of a group: the highest score they allow, and how near x is to q among all."""
    a = queries.select("grp", F.col("block").alias("q"), F.col("centre").alias("qc"), F.col("width").alias("qw"))
    b = index.select("grp", F.col("block").alias("x"), F.col("centre").alias("xc"), F.col("width").alias("xw"))
    cosine = dot(F.col("qc"), F.col("xc"))
    pairs = a.join(b, "grp").select("q", "x", cosine.alias("cosine"), _bound(cosine, F.col("qw") + F.col("xw")).alias("bound"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "x")))


def nearest_neighbours(queries: DataFrame, index: DataFrame, min_score: float = -1e9, probes: int | None = None) -> DataFrame:
    """query_id, vec_id, score: the index vector of a query's group with the largest cosine times 100.

    Both: (vec_id, grp, embedding), all vectors of one length.
    """
    own, other = unit_vectors(queries), unit_vectors(index)
    centres = centres_of(other)
    asked, held = blocks_of(own, centres), blocks_of(other, centres)
    pairs = materialise(block_pairs(asked, held))
    first = materialise(_met(pairs.filter("place = 1"), asked, held))
    rest = pairs.filter("place > 1")
    if probes is None:
        sizes = asked.select(F.col("block").alias("q"), F.size("ids").alias("n"))
        least = first.groupBy("q").agg(F.count("*").alias("found"), F.min("score").alias("least")).join(sizes, "q")
        floor = least.select("q", F.when(F.col("found") == F.col("n"), F.col("least")).alias("floor"))  # none if a query has no row yet
        rest = rest.join(floor, "q", "left").filter("floor is null or bound >= floor")
    else:
        rest = rest.filter(F.col("place") <= probes)
    every = first.unionByName(_met(rest, asked, held))
    best = every.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("low"))).alias("x"))
    return best.select("query_id", (-F.col("x.low")).alias("vec_id"), F.col("x.score").alias("score")).filter(F.col("score") >= min_score)

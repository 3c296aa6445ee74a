"""Sharding by balanced label propagation: linked documents move towards each other, shard sizes stay even.

Every row starts in the shard of its hash.  In each round a row counts its neighbours' shards and asks to move where most
of them are.  Requests between two shards are granted up to the number that wants the opposite way, plus an even part of
what the target may still take; which ones, by gain and then by hash, is decided on a small table of counted cells, never
on the rows of a whole shard.  Rounds go on until no link is cut, or ``STILL`` of them in a row have cut no fewer than the best before;
the best is taken.  Then the few rows above a shard's due are moved, unlinked ones first, so that counts are at
most one apart (law ``rows``), and rows get slots, gapless from 0 in each shard, by counts of hash buckets.

A null text has size 1 and links with nothing.  Rows of equal texts are linked to the first of them, never pair by pair.
Repeated rows are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.shared import write_table

SHARDS = 8
#: Each round lets a random half of the rows move, so one without gain isn't the end.
STILL = 4
SLACK = 0.02
#: Rows in a hash bucket at most, about; buckets are what ranks are counted by.
BUCKET_ROWS = 4_096
CELLS, GAINS = 64, 8


def narrow_rows(docs: DataFrame) -> DataFrame:
    """rid, doc_id, size, text_crc32 and the text's digest: all that is needed, read once."""
    body = F.col("text").cast("string")
    raw = F.coalesce(body, F.lit("")).cast("binary")
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(body.isNotNull(), F.md5(raw)).alias("digest"),
    )


def equal_text_links(rows: DataFrame) -> DataFrame:
    """a, b: each row of a group of equal texts, and the group's first row."""
    groups = rows.filter("digest is not null").groupBy("digest", "size").agg(F.min("rid").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, ["digest", "size"]).filter("rid <> b").select(F.col("rid").alias("a"), "b")


def _bucket(rid: Column, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(rid, F.lit(seed)), F.lit(n)).cast("int")


def propagate(labels: DataFrame, edges: DataFrame, shards: int, rounds: int | None = None, slack: float = SLACK) -> DataFrame:
    """rid, shard when cut links fall no more (or after ``rounds`` rounds) over ``edges`` (a, b) between rows of ``labels`` (rid, shard)."""
    both = write_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    best, still, k = None, 0, -1
    kept = labels
    while rounds is None or k + 1 < rounds:
        k += 1
        sizes = {r.shard: r["count"] for r in labels.groupBy("shard").count().collect()}
        cap = ceil(sum(sizes.values()) / shards * (1 + slack))
        seen = both.join(labels.select(F.col("rid").alias("b"), F.col("shard").alias("to")), "b").groupBy("a", "to").agg(F.count("*").alias("n"))
        own = write_table(seen.join(labels.select(F.col("rid").alias("a"), F.col("shard").alias("at")), "a"), "own")
        cut = own.filter(F.col("to") != F.col("at")).agg(F.sum("n")).first()[0] or 0
        best, still, kept = (cut, 0, labels) if best is None or cut < best else (best, still + 1, kept)
        if not cut or still >= STILL:
            return kept
        wish = own.groupBy("a", "at").agg(F.max(F.struct(F.col("n"), (-F.col("to")).alias("low"))).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("at"), F.col("n"))), F.lit(0)).alias("here"))
        wish = wish.select(F.col("a").alias("rid"), "at", (-F.col("best.low")).alias("to"), (F.col("best.n") - F.col("here")).alias("gain"))
        level = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(GAINS - 1)).cast("int")
        wish = wish.filter((F.col("gain") > 0) & (_bucket(F.col("rid"), 2, k) == 0)).select("rid", "at", "to", level.alias("level"), _bucket(F.col("rid"), CELLS, 100 + k).alias("cell"))
        wish = write_table(wish, "wish")
        cells = wish.groupBy("at", "to", "level", "cell").agg(F.count("*").alias("n"))  # a fixed number of rows at most
        asked = {(r.at, r.to): r.n for r in cells.groupBy("at", "to").agg(F.sum("n").alias("n")).collect()}
        quota = F.lit(0)
        for (at, to), _ in asked.items():
            room = max(0, cap - sizes.get(to, 0)) // max(1, shards - 1)
            quota = F.when((F.col("at") == at) & (F.col("to") == to), F.lit(asked.get((to, at), 0) + room)).otherwise(quota)
        upto = F.sum("n").over(Window.partitionBy("at", "to").orderBy(F.desc("level"), "cell"))
        granted = cells.withColumn("upto", upto).filter(F.col("upto") <= quota).select("at", "to", "level", "cell")
        moves = wish.join(F.broadcast(granted), ["at", "to", "level", "cell"]).select("rid", F.col("to").alias("next"))
        labels = write_table(labels.join(moves, "rid", "left").select("rid", F.coalesce("next", "shard").alias("shard")), "labels")
    return labels


def _ranked(rows: DataFrame, by: list[str], buckets: int, seed: int, name: str) -> DataFrame:
    """``rows`` with the 0-based rank of each inside its shard, ordered by ``by``, then by hash bucket and rid."""
    keyed = rows.withColumn("bucket", _bucket(F.col("rid"), buckets, seed))
    counts = keyed.groupBy("shard", *by, "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy(*by, "bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", *by, "bucket").orderBy("rid")) - 1
    return keyed.withColumn("inside", inside).join(before, ["shard", *by, "bucket"]).withColumn(name, (F.col("before") + F.col("inside")).cast("long")).drop("bucket", "before", "inside")


def even_out(labels: DataFrame, edges: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Move just so many rows, those without links first, that row counts are at most one apart."""
    sizes = {s: 0 for s in range(shards)} | {r.shard: r["count"] for r in labels.groupBy("shard").count().collect()}
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (-sizes[s], s))
    due = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    linked = edges.select(F.col("a").alias("rid")).unionByName(edges.select(F.col("b").alias("rid"))).distinct().withColumn("linked", F.lit(1))
    marked = labels.join(linked, "rid", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    ranked = _ranked(marked, ["linked"], buckets, 7, "rank")
    surplus, first, target, upto = F.lit(0), F.lit(0), F.lit(None).cast("int"), 0
    for s in order:  # numbers of a fixed count of shards
        over = max(0, sizes[s] - due[s])
        surplus = F.when(F.col("shard") == s, F.lit(over)).otherwise(surplus)
        first = F.when(F.col("shard") == s, F.lit(upto)).otherwise(first)
        upto += over
    place, upto = first + F.col("rank"), 0
    for s in order:
        lack = max(0, due[s] - sizes[s])
        target = F.when((place >= upto) & (place < upto + lack), F.lit(s)).otherwise(target)
        upto += lack
    return ranked.select("rid", F.when(F.col("rank") < surplus, target).otherwise(F.col("shard")).cast("int").alias("shard"))


def shard_rows(rows: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """rid, shard, slot for ``rows`` (rid) with links ``edges`` (a, b)."""
    total = rows.count()
    buckets = max(16, ceil(total / shards / BUCKET_ROWS))
    labels = rows.select("rid", _bucket(F.col("rid"), shards, 1).alias("shard"))
    labels = propagate(labels, edges, shards, rounds)
    even = write_table(even_out(labels, edges, shards, buckets), "even")
    return _ranked(even, [], buckets, 11, "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``; equal texts are linked."""
    rows = write_table(narrow_rows(docs), "rows")
    edges = write_table(equal_text_links(rows), "links")
    placed = shard_rows(rows.select("rid"), edges, shards)
    return rows.join(placed, "rid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

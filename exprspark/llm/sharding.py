"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `VIRTUAL` points of the ring; a document belongs to the first point clockwise of its
hash. A shard takes no more than its capacity, floor or ceiling of rows / shards: documents that
overflow a full shard continue clockwise to the next shard with room. So the counts differ by one
at most, and only the overflow moves.

The walk is decided on the counts of the arcs between points (shards * VIRTUAL numbers); a document
then finds its shard by its rank within its arc, counted in cells of the hash space.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprspark.llm import hashing
from exprspark.session import cut

SHARDS = 8
VIRTUAL = 128
CELL_ROWS = 20_000


def ring(shards: int = SHARDS, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions, owning shard) of the virtual nodes."""
    spot = hashing.mix(np.arange(1, shards * virtual + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)
    order = np.argsort(spot, kind="stable")
    return spot[order], (order // virtual).astype(np.int64)


def arc_of(place: Column, shards: int, virtual: int) -> Column:
    """Index of the first virtual node clockwise."""

    @F.pandas_udf("int")
    def find(value: pd.Series) -> pd.Series:
        spots, _ = ring(shards, virtual)
        return pd.Series((np.searchsorted(spots, value.to_numpy(np.int64), "left") % len(spots)).astype(np.int32))

    return find(place)


def walk(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot) that place every document of every arc."""
    total = int(counts.sum())
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    filled = np.zeros(shards, dtype=np.int64)
    segments, over = [], []

    def take(arc: int, at: int, n: int, shard: int) -> None:
        segments.append((arc, at, at + n, shard, int(filled[shard])))
        filled[shard] += n
        room[shard] -= n

    for arc, count in enumerate(counts.tolist()):
        stay = int(min(count, room[owner[arc]]))
        if stay:
            take(arc, 0, stay, int(owner[arc]))
        if stay < count:
            over.append((arc, stay, count))
    for arc, at, end in over:
        step = arc
        while at < end:
            step = (step + 1) % len(owner)
            n = int(min(end - at, room[owner[step]]))
            if n:
                take(arc, at, n, int(owner[step]))
                at += n
    return segments


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law, shard, slot, grown_shard of every row.

    The law is `rows`: shard counts differ by one at most. slot counts 0, 1, ... within a shard. grown_shard is null,
    since with bounded loads a new shard also changes who overflows. The place on the ring is a hash of id and text, so
    copies of a text spread out. Rows that repeat each other are counted as one with a multiplicity and placed apart.
    Null ids hash like any other value. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                           F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), text).alias("place"))
               .groupBy("doc_id", "size", "text_crc32", "place").agg(F.count(F.lit(1)).alias("n")))
    distinct = rows.count()
    bits = min(40, max(0, int(distinct // CELL_ROWS).bit_length()))
    placed = rows.withColumn("arc", arc_of(F.col("place"), shards, virtual)).withColumn("cell", F.shiftright("place", 64 - bits) if bits else F.lit(0).cast("bigint"))
    placed = cut(placed)
    cells = placed.groupBy("arc", "cell").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # the last arc closes the ring: it holds the hashes above the last point and below the first
    offsets = cells.select("arc", "cell", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["arc", "cell"]).withColumn("first", F.col("offset") + F.col("before"))
    ranked = ranked.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))

    counts = np.zeros(shards * virtual, dtype=np.int64)
    for arc, held in cells.groupBy("arc").agg(F.sum("held")).collect():  # one row per virtual node
        counts[arc] = held
    segments = docs.sparkSession.createDataFrame(walk(counts, ring(shards, virtual)[1], shards) or [(-1, 0, 0, 0, 0)], "on int, low bigint, high bigint, shard int, base bigint")
    hit = (F.col("arc") == F.col("on")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    joined = ranked.join(F.broadcast(segments), hit)  # at most shards * (shards + 1) * virtual rows
    return joined.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

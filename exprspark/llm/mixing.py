"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted target / size times: the whole part of that ratio are full
copies, the rest is an inclusion probability. The cube method (Deville and Tille 2004) moves the
probabilities through the null space of the balancing constraints (documents and words), so that
both totals hold while one probability after another becomes 0 or 1. It runs over blocks of a
source; the few undecided documents of each block go to the next level, until one block per source
and at most three undecided documents are left, which are landed by their words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprspark.session import cut

BLOCK = 1500
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share all sizes; a target stops
    at `CAP` times its source's size and the excess is shared by weight among the others until none
    is above. In the end the capped sources are those with the smallest size per weight, so the
    shares are settled in one pass over the sources in that order. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    room = (F.col("source_size") * F.lit(CAP) / F.col("weight")).alias("room")
    by_room = Window.orderBy("room", F.col("source").isNull(), "source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    open_ = weighed.withColumn("room", room).select(
        "*", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * CAP).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"))
    # sources in order of room: capped while an equal share of what is left exceeds the room
    level = F.min(F.when(F.col("room") * F.col("weights") >= F.col("left"), F.struct("room", (F.col("left") / F.col("weights")).alias("share")))).over(Window.partitionBy())
    settled = open_.withColumn("level", level["share"])
    return settled.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("room") < F.col("level")), F.col("source_size") * F.lit(float(CAP))).otherwise(F.col("level") * F.col("weight")).alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractional probabilities along the null space of (p, p * size) until at most two are fractional."""
    eps = 1e-9
    value, size = p.tolist(), (sizes / max(float(sizes.mean()), 1.0)).tolist() if len(p) else []
    pool = [int(i) for i in rng.permutation(len(value)) if eps < value[i] < 1 - eps]
    draws = rng.random(2 * len(value) + 3).tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and pool:
            active.append(pool.pop())
        if len(active) < 3:
            break
        # the null vector of the rows (1, 1, 1) and (sizes) is their cross product
        i, j, k = active
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        steps = [(value[m], d) for m, d in zip(active, u) if d]
        up = min((1 - x) / d if d > 0 else -x / d for x, d in steps)
        down = min(x / d if d > 0 else (x - 1) / d for x, d in steps)
        move = up if draws.pop() < down / (up + down) else -down
        for m, d in zip(active, u):
            x = value[m] + move * d
            value[m] = 0.0 if x < eps else 1.0 if x > 1 - eps else x
        active = [m for m in active if 0.0 < value[m] < 1.0]
    return np.asarray(value)


def _seed(rows: pd.DataFrame, level: int) -> np.random.Generator:
    return np.random.default_rng([level, len(rows), int(rows["key"].to_numpy(np.int64).view(np.uint64)[0] >> np.uint64(1))])


def _fly(level: int, names: list[str]):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[names].sort_values(["key", "size"], kind="stable").reset_index(drop=True)
        rows["p"] = flight(rows["p"].to_numpy(float), rows["size"].to_numpy(float), _seed(rows, level))
        return rows

    return block


def _land(rows: pd.DataFrame) -> pd.DataFrame:
    """Decide the last undecided documents of a source: the choice whose words come nearest to their expectation, then whose count does."""
    rows = rows.sort_values(["key", "size"], kind="stable").reset_index(drop=True)
    p, size = rows["p"].to_numpy(float), rows["size"].to_numpy(float)
    choices = np.array(np.meshgrid(*[[0.0, 1.0]] * len(p))).reshape(len(p), -1).T
    miss = np.abs(choices @ size - p @ size)
    rows["p"] = choices[np.lexsort((np.abs(choices.sum(1) - p.sum()), np.round(miss, 6)))[0]]
    return rows


def balanced_sample(rows: DataFrame) -> DataFrame:
    """`p` of rows (source, key, size, p, ...) moved to 0 or 1. key orders and seeds; equal keys are allowed."""
    decided: list[DataFrame] = []
    current, level = rows, 0
    schema = rows.schema
    while True:
        open_ = current.where("p > 1e-9 and p < 1 - 1e-9")
        decided.append(current.where("not (p > 1e-9 and p < 1 - 1e-9)").withColumn("p", F.round("p")))
        largest = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if not largest:
            break
        if largest <= 2 and level:
            decided.append(open_.groupBy("source").applyInPandas(_land, schema))
            break
        counts = open_.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).withColumnRenamed("source", "of")
        placed = open_.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        names = [f.name for f in schema]
        current = cut(placed.select(*names, "block").groupBy("source", "block").applyInPandas(_fly(level, names), schema))
        level += 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_key, source, size, source_size, target, copies, taken.

    copies is how often the row is taken (0 to 3), taken is copies * size. A row without words takes none but is
    sampled like the others. Reruns agree: draws depend on the rows alone. Rows that repeat each other are
    interchangeable. With no words at all the targets are 0 and every document is taken 0 times.
    """
    rows = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "source", word_count().alias("size")))
    wanted = targets(rows).withColumnRenamed("source", "of")
    joined = rows.join(wanted, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    ready = joined.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)).withColumn("key", F.xxhash64("doc_id", "text_key"))
    chosen = balanced_sample(cut(ready))
    copies = (F.col("whole") + F.col("p")).cast("bigint")
    return chosen.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

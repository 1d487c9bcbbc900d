"""Exact k-means by Shallot search.

Every vector keeps, from round to round, its centroid, the second nearest one it knew, an upper bound of its
distance to the first and a lower bound of its distance to any other. Bounds are moved by how far
centroids moved. A vector whose upper bound stays below its lower bound, or below half the gap from its
centroid to the next, keeps its centroid unseen. Any other vector is measured against both remembered centroids and
searches around the closer one: that one's neighbours are scanned by rising gap until the gap exceeds
the radius of the ball in which a nearest or second nearest can lie, which shrinks with every closer centroid
found. Bounds are floating point and prune with slack; what survives is compared by squared distances in 64-bit
integers, so assignments are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.session import cut, discard

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Components are clamped to this size: 64 squares of twice as much still sum to no more than a long holds.
LARGEST = 1 << 27
SLACK = 1e-9
LONGEST = (1 << 63) - 1


def quantised(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where the vector has not exactly `dimensions` finite components."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    inside = lambda x: F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return F.when((F.size(vector) == dimensions) & whole, F.transform(vector, lambda x: F.floor(inside(x.cast("double") * scale)).cast("int")))


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row (or of all rows to one centre)."""
    gap = rows - centres
    return np.einsum("ij,ij->i", gap, gap)


class Centroids:
    """Centroids of one round with their gaps, each one's neighbours by rising gap, and the way each has come."""

    def __init__(self, centres: list[list[int]], before: list[list[int]] | None = None):
        self.at = np.asarray(centres, np.int64).reshape(len(centres), -1)
        self.gaps = np.sqrt(np.array([squared(self.at, c) for c in self.at], float))
        self.near = [[int(c) for c in np.argsort(row, kind="stable") if c != s] for s, row in enumerate(self.gaps)]
        self.half = np.array([row[n[0]] / 2 if n else np.inf for row, n in zip(self.gaps, self.near)])
        moved = np.sqrt(squared(self.at, np.asarray(before, np.int64)).astype(float)) if before else np.zeros(len(centres))
        self.moved = moved
        self.others_moved = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])


def search(rows: np.ndarray, one: np.ndarray, two: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, second nearest, squared distance to each) of every row; ties go to the smaller number. one and two
    are the remembered centroids, distinct. At least two centroids."""
    at = centroids.at
    d1, d2 = squared(rows, at[one]), squared(rows, at[two])
    swap = (d2 < d1) | ((d2 == d1) & (two < one))
    start, other = np.where(swap, two, one), np.where(swap, one, two)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    first, second = start.copy(), other.copy()
    radius = np.sqrt(d1.astype(float))
    for s in np.unique(start).tolist():
        live = np.flatnonzero(start == s)
        for c in centroids.near[s]:
            live = live[centroids.gaps[s, c] <= (radius[live] + np.sqrt(d2[live].astype(float))) * (1 + SLACK)]
            if not len(live):
                break
            seen = live[other[live] != c]
            d = squared(rows[seen], at[c])
            closer = (d < d1[seen]) | ((d == d1[seen]) & (c < first[seen]))
            between = ~closer & (d < d2[seen])
            hit = seen[closer]
            second[hit], d2[hit], first[hit], d1[hit] = first[hit], d1[hit], c, d[closer]
            hit = seen[between]
            second[hit], d2[hit] = c, d[between]
    return first, second, d1, d2


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def assigner(centroids: Centroids, first_time: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over (vec_id, v, one, two, upper, lower); the last pass returns (vec_id, cluster, distance)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("v"))
            if len(centroids.at) == 1:
                one, two = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                upper, lower = np.zeros(len(rows)), np.full(len(rows), np.inf)
            else:
                one, two = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("one", "two"))
                upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
                open_ = np.arange(len(rows))
                if not first_time:
                    upper += centroids.moved[one]
                    lower -= centroids.others_moved[one]
                    bound = np.maximum(lower, centroids.half[one]) * (1 - SLACK)
                    open_ = np.flatnonzero(upper >= bound)
                    upper[open_] = np.sqrt(squared(rows[open_], centroids.at[one[open_]]).astype(float)) * (1 + SLACK)
                    open_ = open_[upper[open_] >= bound[open_]]
                one[open_], two[open_], d1, d2 = search(rows[open_], one[open_], two[open_], centroids)
                upper[open_], lower[open_] = np.sqrt(d1.astype(float)) * (1 + SLACK), np.sqrt(d2.astype(float)) * (1 - SLACK)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(one, pa.int32()), pa.array(squared(rows, centroids.at[one]))], names=["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(upper), pa.array(lower)],
                                                 names=["vec_id", "v", "one", "two", "upper", "lower"])

    return work


def totals(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(count, componentwise sum) of every non-empty cluster, summed per partition first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, one = matrix(batch.column("v")), batch.column("one").to_numpy(zero_copy_only=False)
            for c in np.unique(one).tolist():
                mine = rows[one == c]
                counts[c] = counts.get(c, 0) + len(mine)
                sums[c] = sums.get(c, 0) + mine.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))],
                                         names=["one", "n", "sums"])

    parts = table.select("one", "v").mapInArrow(partial, "one int, n bigint, sums array<bigint>")
    cells = parts.select("one", "n", F.posexplode("sums").alias("i", "s")).groupBy("one", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(cells.collect(), key=lambda r: (r["one"], r["i"])):  # clusters * dimensions rows
        found.setdefault(r["one"], (r["n"], []))[1].append(int(r["s"]))
    return found


def digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of vectors (vec_id, embedding).

    Kept are vectors with exactly `dimensions` components, none null or not finite; components are clamped to +-2**27
    after scaling. Rows are judged one by one: repeated ids and repeated vectors each give a row, a null id hashes as an empty one, other
    columns are ignored. With fewer vectors than `clusters` each is a centroid; equal centroids leave the later ones empty.
    Without vectors there are no rows. Inertias beyond a long are given as the largest long.
    """
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding"), dimensions, scale).alias("v")).where("v is not null")
    table = cut(kept.withColumns({"one": F.lit(0), "two": F.lit(1), "upper": F.lit(0.0), "lower": F.lit(0.0)}))
    centres = [list(r.v) for r in table.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()]
    if not centres:
        return table.select("vec_id", F.col("one").alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    before = None
    schema = table.schema
    for r in range(rounds):
        step = cut(table.mapInArrow(assigner(Centroids(centres, before), r == 0, False), schema))
        discard(table)
        table, before = step, centres
        found = totals(table)
        centres = [[s // found[c][0] for s in found[c][1]] if c in found else centre for c, centre in enumerate(centres)]
    final = cut(table.mapInArrow(assigner(Centroids(centres, before), rounds == 0, True), "vec_id bigint, cluster int, distance bigint"))
    discard(table)
    sums = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one row per cluster
    total = min(sum(sums.values()), LONGEST)
    side = final.sparkSession.createDataFrame([(c, min(d, LONGEST), total, digest(centres[c])) for c, d in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return final.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most `clusters` rows

"""Signature scores per sample and set. members: (set_id, feature_id[, weight]), one row per entry."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import counted_join, one_row, rank_ties, row_numbers, running, spread_join
from exprspark.functions.tails import normal_cdf
from exprspark.operators.enrich import running_extremes
from exprspark.operators.linear import dense_blocks
from exprspark.operators.matrix import feature_moments


def _sample_grid(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Every (set, sample): the result's own shape, needed because absent cells are zeros."""
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    return cells.select("sample_id").distinct().crossJoin(sizes)


def _joined(cells: DataFrame, members: DataFrame) -> DataFrame:
    return spread_join(cells, members, ["feature_id"], "sample_id")


def score_mean(cells: DataFrame, members: DataFrame) -> DataFrame:
    sums = _joined(cells, members).groupBy("set_id", "sample_id").agg(F.sum("value").alias("_s"))
    return _sample_grid(cells, members).join(sums, ["set_id", "sample_id"], "left").select(
        "set_id", "sample_id", (F.coalesce("_s", F.lit(0.0)) / F.col("k")).alias("score"))


def variable_members(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Entries with their feature's mean and deviation, and whether a constant feature excludes
    them."""
    moments = feature_moments(cells).select("feature_id", "mean", F.sqrt("var_samp").alias("sd"))
    return members.join(moments, "feature_id", "left").withColumn("used", F.coalesce(F.col("sd") > 0, F.lit(False)))


def score_mean_z(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Mean z over variable features. z of an absent cell is -mean/sd, so each set carries the sum
    of those and present cells add value/sd."""
    used = variable_members(cells, members).where("used").select("set_id", "feature_id", "mean", "sd")
    base = used.groupBy("set_id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("mean") / F.col("sd")).alias("_b"))
    sums = _joined(cells, used.drop("mean")).groupBy("set_id", "sample_id").agg(F.sum(F.col("value") / F.col("sd")).alias("_s"))
    grid = cells.select("sample_id").distinct().crossJoin(base)
    return grid.join(sums, ["set_id", "sample_id"], "left").select(
        "set_id", "sample_id", ((F.coalesce("_s", F.lit(0.0)) - F.col("_b")) / F.col("k")).alias("score"))


def score_weighted(cells: DataFrame, members: DataFrame) -> DataFrame:
    sums = _joined(cells, members).groupBy("set_id", "sample_id").agg(F.sum(F.col("weight") * F.col("value")).alias("_s"))
    return _sample_grid(cells, members).join(sums, ["set_id", "sample_id"], "left").select(
        "set_id", "sample_id", F.coalesce("_s", F.lit(0.0)).alias("score"))


def sample_ranks(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(average ranks of present cells among all features of their sample, rank of a zero per
    sample). The absent cells of a sample are one block of ties at zero."""
    features = cells.agg(F.count_distinct("feature_id").alias("_n"))
    ties = cells.groupBy("sample_id", "value").agg(F.count(F.lit(1)).alias("ties"))
    present = ties.groupBy("sample_id").agg(F.sum("ties").alias("_k"))
    absent = one_row(present, features).select("sample_id", F.lit(0.0).alias("value"), (F.col("_n") - F.col("_k")).alias("ties"))
    whole = ties.unionByName(absent).groupBy("sample_id", "value").agg(F.sum("ties").alias("ties")).where("ties > 0")
    ranked = rank_ties(whole, ["sample_id"], "value").select("sample_id", "value", "ties", "avg_rank")
    cells_ranked = counted_join(cells, ranked, ["sample_id", "value"], "ties").select("feature_id", "sample_id", F.col("avg_rank").alias("rank"))
    zero = ranked.where("value = 0").select("sample_id", F.col("avg_rank").alias("zero_rank"))
    return cells_ranked, zero


def score_rank(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Mean percentile rank within the sample over all features. The ranks use every feature, so
    the set filter comes after them."""
    ranks, zero = sample_ranks(cells)
    sums = _joined(ranks, members).groupBy("set_id", "sample_id").agg(F.sum("rank").alias("_s"), F.count(F.lit(1)).alias("_k"))
    grid = one_row(_sample_grid(cells, members).join(sums, ["set_id", "sample_id"], "left").join(zero, "sample_id", "left"),
                   cells.agg(F.count_distinct("feature_id").alias("_n")))
    whole = F.coalesce("_s", F.lit(0.0)) + (F.col("k") - F.coalesce("_k", F.lit(0))) * F.coalesce("zero_rank", F.lit(0.0))
    return grid.select("set_id", "sample_id", (whole / F.col("k") / F.col("_n")).alias("score"))


def score_ssgsea(cells: DataFrame, members: DataFrame, alpha: float = 0.25, normalize: bool = True) -> DataFrame:
    """Single-sample running-sum score (Barbie et al. 2009) of dense cells. The area between the two
    step functions depends only on the members' places, so each set sums over its members."""
    ranks, _ = sample_ranks(cells)
    ordered = row_numbers(ranks.withColumn("rank", F.floor("rank")).withColumn("_down", -F.col("rank")), ["sample_id"], ["_down", "feature_id"], "position")
    hits = one_row(_joined(ordered.select("feature_id", "sample_id", "rank", "position"), members.select("set_id", "feature_id").distinct()),
                   cells.agg(F.count_distinct("feature_id").alias("_n")))
    after = F.col("_n") - F.col("position") + 1
    weight = F.pow(F.abs(F.col("rank").cast("double")), F.lit(alpha))
    per = hits.groupBy("set_id", "sample_id").agg(
        F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum(weight * after).alias("_wa"), F.sum(weight).alias("_w"), F.sum(after).alias("_a"))
    # a set of all features has no others to compare with, members of no weight have no step: null
    area = F.try_divide("_wa", "_w") - F.try_divide(F.col("_n") * (F.col("_n") + 1) / 2 - F.col("_a"), F.col("_n") - F.col("_k"))
    scored = per.select("set_id", "sample_id", area.alias("score"))
    if not normalize:
        return scored
    return one_row(scored, scored.agg((F.max("score") - F.min("score")).alias("_range"))).select(
        "set_id", "sample_id", F.try_divide("score", "_range").alias("score"))


# Bins of half a bandwidth, series of 15 terms over a quarter of one (remainder below 1e-15), and the distance in bins
# beyond which a Gaussian is 0 or 1 to the last digit.
KERNEL_BIN, KERNEL_TERMS, KERNEL_REACH = 0.5, 15, 20


def _kernel_table() -> np.ndarray:
    """Derivatives 0, 1, ... of the normal distribution at every distance between two bin centres: distances x derivatives."""
    away = np.arange(-KERNEL_REACH, KERNEL_REACH + 1) * KERNEL_BIN
    out = [normal_cdf(away), np.exp(-away * away / 2) / math.sqrt(2 * math.pi)]
    for q in range(2, 2 * KERNEL_TERMS - 1):
        out.append(-away * out[q - 1] - (q - 2) * out[q - 2] if q > 2 else -away * out[1])
    return np.stack(out, axis=1)


def kernel_shares(values: np.ndarray, h: float) -> np.ndarray:
    """Mean over all values of the normal distribution at (value - other) / h. Values are summed as power moments about bin centres and
    read off as a series about the centre of one's own bin, so the work grows with their number, not with its square."""
    distinct, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    z = (distinct - distinct[0]) / h
    bins, own = np.unique(np.floor(z / KERNEL_BIN), return_inverse=True)
    delta = z - (bins[own] + 0.5) * KERNEL_BIN
    powers = np.stack([delta**k / math.factorial(k) for k in range(KERNEL_TERMS)])
    moments = np.stack([np.bincount(own, (-1) ** k * counts * powers[k], len(bins)) for k in range(KERNEL_TERMS)], axis=1)
    table, order = _kernel_table(), np.arange(KERNEL_TERMS)
    below = np.concatenate([[0], np.cumsum(moments[:, 0])])
    local = np.zeros_like(moments)
    local[:, 0] = below[np.searchsorted(bins, bins - KERNEL_REACH)]  # bins so far below count whole
    for d in range(-KERNEL_REACH, KERNEL_REACH + 1):
        other = np.minimum(np.searchsorted(bins, bins - d), len(bins) - 1)
        met = bins[other] == bins - d
        local[met] += moments[other[met]] @ table[d + KERNEL_REACH][order[:, None] + order[None, :]]
    return ((local[own] * powers.T).sum(1) / len(values))[at]


def feature_cdf(cells: DataFrame, kernel: str = "gaussian") -> DataFrame:
    """Each cell's place in its feature's distribution over samples: Gaussian kernel, Poisson
    kernel, or the empirical share of values not above it."""
    if kernel == "none":
        ties = cells.groupBy("feature_id", "value").agg(F.count(F.lit(1)).alias("ties"))
        sizes = ties.groupBy("feature_id").agg(F.sum("ties").alias("_n"))
        placed = running(ties, ["feature_id"], ["value"], ["ties"]).join(sizes, "feature_id")
        share = placed.select("feature_id", "value", "ties", ((F.col("ties_before") + F.col("ties")) / F.col("_n")).alias("density"))
        return counted_join(cells, share, ["feature_id", "value"], "ties").select("feature_id", "sample_id", "density")
    samples = [r[0] for r in cells.select("sample_id").distinct().orderBy("sample_id").collect()]  # the cohort's ids

    def gaussian(names, matrix, _):
        return np.array([kernel_shares(row, max(row.std(ddof=1) / 4, 1e-12)) for row in matrix])

    def poisson(names, matrix, _):

        out = np.empty_like(matrix)
        for i, row in enumerate(matrix):
            values, counts = np.unique(row, return_counts=True)
            share = {}
            for v in values:
                k = np.arange(int(math.floor(v)) + 1)
                logs = np.array([math.lgamma(j + 1) for j in k])
                rates = values + 0.5
                share[v] = float((np.exp(k[None, :] * np.log(rates)[:, None] - rates[:, None] - logs[None, :]).sum(1) * counts).sum() / counts.sum())
            out[i] = [share[v] for v in row]
        return out

    smooth = {"gaussian": gaussian, "poisson": poisson}[kernel]

    def work(names, matrix, side):
        density = smooth(names, matrix, side)
        return pd.DataFrame({"feature_id": np.repeat(names, len(samples)), "sample_id": np.tile(np.asarray(samples, dtype=object), len(names)), "density": density.ravel()})

    return dense_blocks(cells, samples, work, "feature_id string, sample_id string, density double")


def score_gsva(cells: DataFrame, members: DataFrame, kernel: str = "gaussian", tau: float = 1.0, max_diff: bool = True, abs_ranking: bool = False) -> DataFrame:
    """Variation score (Hänzelmann et al. 2013): features of a sample are ordered by their place in
    their own distribution; a set scores by the extremes of its weighted running sum, read off its
    members alone."""
    density = feature_cdf(cells, kernel).withColumn("_down", -F.round("density", 12))
    ordered = row_numbers(density, ["sample_id"], ["_down", "feature_id"], "position")
    count = cells.agg(F.count_distinct("feature_id").alias("feature_count"))
    hits = one_row(_joined(ordered.select("feature_id", "sample_id", "position"), members.select("set_id", "feature_id").distinct()), count)
    sizes = hits.groupBy("set_id", "sample_id").agg(F.count(F.lit(1)).alias("set_size"))
    weight = F.pow(F.abs(F.col("feature_count") / 2.0 - (F.col("feature_count") - F.col("position") + 1)), F.lit(tau))

    placed = running_extremes(hits.join(sizes, ["set_id", "sample_id"]).withColumn("weight", weight), ["set_id", "sample_id"])
    per = placed.groupBy("set_id", "sample_id").agg(F.greatest(F.max("high"), F.lit(0.0)).alias("h"), F.least(F.min("low"), F.lit(0.0)).alias("l"))
    if max_diff:
        score = F.col("h") - F.col("l") if abs_ranking else F.col("h") + F.col("l")
    else:
        score = F.when(F.col("h") > F.abs("l"), F.col("h")).otherwise(F.col("l"))
    return per.select("set_id", "sample_id", score.alias("score"))


def score_summary(scores: DataFrame, members: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Range and mean per set with entry counts and mapping coverage. `requested` is
    (set_id, requested_identifier_count, unique_identifier_count)."""
    mapped = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("mapped_identifier_count"), F.count_if("used").alias("scored_feature_count"))
    per = scores.groupBy("set_id").agg(F.min("score").alias("score_minimum"), F.max("score").alias("score_maximum"), F.avg("score").alias("score_mean"))
    out = per.join(mapped, "set_id").withColumn("excluded_constant_feature_count", F.col("mapped_identifier_count") - F.col("scored_feature_count"))
    if requested is not None:
        out = out.join(requested, "set_id").withColumn("mapping_coverage", F.col("mapped_identifier_count") / F.col("unique_identifier_count"))
    return out

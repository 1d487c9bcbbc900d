"""Composition estimates and comparison of methods. Estimates: (sample_id, cell_type_id, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import spread_join
from exprspark.operators.matrix import scale_features, top_variable
from exprspark.operators.score import score_mean
from exprspark.session import cut


def decon_markers(cells: DataFrame, markers: DataFrame) -> DataFrame:
    """Mean of each population's markers that the matrix has; cells' feature_id are symbols,
    markers are (cell_type_id, gene)."""
    seen = cells.select(F.col("feature_id").alias("gene")).distinct()
    members = markers.distinct().join(seen, "gene", "left_semi").select(F.col("cell_type_id").alias("set_id"), F.col("gene").alias("feature_id"))
    return score_mean(cells, members).select("sample_id", F.col("set_id").alias("cell_type_id"), F.col("score").alias("value"))


def _bounded_fit(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Minimise x'Gx/2 - c'x over x >= 0 and sum(x) <= 1 by active sets; K is the number of
    populations."""
    def solve(active: list[int], tied: bool) -> np.ndarray:
        if not tied:
            return np.linalg.solve(g[np.ix_(active, active)], c[active])
        k = len(active)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k], system[:k, k], system[k, :k] = g[np.ix_(active, active)], 1.0, 1.0
        return np.linalg.solve(system, np.append(c[active], 1.0))[:k]

    def run(tied: bool) -> np.ndarray:
        size = len(c)
        x = np.zeros(size)
        if tied:
            x[int(np.argmax(c - np.diag(g) / 2))] = 1.0
        active = list(np.flatnonzero(x))
        for _ in range(30 * size):
            while active:
                target = np.zeros(size)
                target[active] = solve(active, tied)
                if (target[active] > -1e-14).all():
                    x = np.maximum(target, 0.0)
                    break
                falling = [i for i in active if target[i] <= -1e-14]
                step = min(x[i] / (x[i] - target[i]) for i in falling)
                x = x + step * (target - x)
                gone = [i for i in active if x[i] <= 1e-14]
                active = [i for i in active if i not in (gone or falling[:1])]
                x[[i for i in range(size) if i not in active]] = 0.0
            gradient = c - g @ x
            level = float(np.mean(gradient[active])) if tied and active else 0.0
            rest = [i for i in range(size) if i not in active and gradient[i] - level > 1e-10 * max(1.0, np.abs(c).max())]
            if not rest:
                return x
            active.append(max(rest, key=lambda i: gradient[i]))
        return x

    free = run(False)
    return free if free.sum() <= 1 + 1e-12 else run(True)


def decon_fractions(cells: DataFrame, signature: DataFrame) -> DataFrame:
    """Non-negative fractions with sum at most one that best rebuild each sample from a signature
    (gene, cell_type_id, value); what is left over is `other`. The K x K products of the signature
    reach the driver, the K sums per sample stay in their row."""
    genes = cut(signature.join(cells.select(F.col("feature_id").alias("gene")).distinct(), "gene", "left_semi"))
    profile = genes.alias("a").join(genes.alias("b"), "gene").groupBy(F.col("a.cell_type_id").alias("i"), F.col("b.cell_type_id").alias("j")).agg(
        F.sum(F.col("a.value") * F.col("b.value")).alias("v")).toPandas()  # populations squared
    names = sorted(set(profile["i"]))
    place = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    g[profile["i"].map(place), profile["j"].map(place)] = profile["v"]
    side = genes.select(F.col("gene").alias("feature_id"), "cell_type_id", F.col("value").alias("_s"))
    products = spread_join(cells, side, ["feature_id"], "sample_id")
    pick = [F.sum(F.when(F.col("cell_type_id") == n, F.col("_s") * F.col("value")).otherwise(0.0)) for n in names]
    per = products.groupBy("sample_id").agg(F.array(*pick).alias("c"))

    def solve(batches):
        for batch in batches:
            fits = [_bounded_fit(g, np.asarray(c, dtype=float)) for c in batch["c"]]
            yield pd.DataFrame({
                "sample_id": np.repeat(batch["sample_id"].to_numpy(object), len(names) + 1), "cell_type_id": [*names, "other"] * len(fits),
                "value": [v for x in fits for v in (*x, max(0.0, 1 - x.sum()))]})

    return per.mapInPandas(solve, "sample_id string, cell_type_id string, value double")


def composition(estimates: DataFrame) -> DataFrame:
    total = F.sum("value")
    return estimates.groupBy("sample_id").agg(
        total.alias("reported_sum"), F.greatest(F.lit(0.0), 1 - total).alias("residual_fraction"), (F.abs(total - 1) <= 1e-6).alias("within_tolerance"))


def population_z(estimates: DataFrame, top: int = 20) -> DataFrame:
    """z within each of the most variable populations."""
    cells = estimates.select(F.col("cell_type_id").alias("feature_id"), "sample_id", "value")
    chosen = top_variable(cells, top, keep_constant=True).select("feature_id")
    scaled = scale_features(cells.join(F.broadcast(chosen), "feature_id"))  # at most `top` populations
    return scaled.select("sample_id", F.col("feature_id").alias("cell_type_id"), F.col("value").alias("z"))


def check_estimates(estimates: DataFrame, samples: DataFrame, populations: DataFrame) -> DataFrame:
    """(code, sample_id, cell_type_id): repeated, non-finite, unknown, and absent entries of the
    full sample x population grid."""
    key = ["sample_id", "cell_type_id"]
    odd = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    wanted = samples.select("sample_id").distinct().crossJoin(populations.select("cell_type_id").distinct())
    parts = [
        estimates.groupBy(*key).count().where("count > 1").select(F.lit("DUPLICATE").alias("code"), *key),
        estimates.where(odd).select(F.lit("NOT_FINITE").alias("code"), *key),
        estimates.join(samples, "sample_id", "left_anti").select(F.lit("UNKNOWN_SAMPLE").alias("code"), *key),
        estimates.join(populations, "cell_type_id", "left_anti").select(F.lit("UNKNOWN_POPULATION").alias("code"), *key),
        wanted.join(estimates, key, "left_anti").select(F.lit("ABSENT").alias("code"), *key),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# What two runs must share to be compared.
SECTION = ["result_type", "unit", "assay", "bundle"]


def run_sections(runs: DataFrame, estimates: DataFrame) -> DataFrame:
    """(run, section): runs share a section when type, unit, assay, bundle and sample list agree.
    The list is compared by a sum of hashes and a count, which need no gathering."""
    samples = estimates.select("run", "sample_id").distinct().groupBy("run").agg(
        F.sum(F.conv(F.substring(F.md5("sample_id"), 1, 12), 16, 10).cast("decimal(38,0)")).alias("_h"), F.count(F.lit(1)).alias("sample_count"))
    joined = runs.join(samples, "run")
    section = F.sha2(F.concat_ws("|", *SECTION, F.col("_h").cast("string"), F.col("sample_count").cast("string")), 256)
    return joined.select("run", "method", F.substring(section, 1, 16).alias("section"), "sample_count")


def compare_runs(runs: DataFrame, estimates: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of methods in a section and every population that all its
    runs share by id and label. Runs per section are few; their estimates meet on the sample."""
    placed = run_sections(runs, estimates)
    rows = estimates.join(placed, "run")
    size = placed.groupBy("section").agg(F.count(F.lit(1)).alias("_runs"))
    label = F.col("label") if "label" in estimates.columns else F.col("cell_type_id")
    shared = rows.select("section", "cell_type_id", label.alias("_label"), "run").distinct().groupBy("section", "cell_type_id", "_label").agg(
        F.count(F.lit(1)).alias("_k")).join(size, "section").where("_k = _runs").select("section", "cell_type_id")
    kept = rows.join(shared, ["section", "cell_type_id"]).where("sample_count >= 3")
    left = kept.select("section", "cell_type_id", "sample_id", "sample_count", F.col("run").alias("left_run"), F.col("method").alias("left_method"), F.col("value").alias("x"))
    right = kept.select("section", "cell_type_id", "sample_id", F.col("run").alias("right_run"), F.col("method").alias("right_method"), F.col("value").alias("y"))
    pairs = left.join(right, ["section", "cell_type_id", "sample_id"]).where("left_run < right_run and left_method <> right_method")
    per = pairs.groupBy("section", "left_run", "right_run", "cell_type_id").agg(
        F.max("sample_count").alias("sample_count"), F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("_x"), F.stddev_pop("y").alias("_y"))
    return per.where("_x > 0 and _y > 0").select(
        "left_run", "right_run", "cell_type_id", "sample_count", F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0)).alias("pearson_correlation"))

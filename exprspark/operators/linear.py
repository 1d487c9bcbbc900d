"""Linear models of every feature at once: sums in Spark, small solves on batches of features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import medians, one_row, quantiles, row_numbers, running, spread_join, suffix_min, counted_join
from exprspark.functions.tails import digamma, t_pvalue, trigamma, trigamma_inverse
from exprspark.operators.design import Encoded, cross_products, matrix_rank
from exprspark.operators.grouped import Counts, LogLevels
from exprspark.session import cut

DENSE_CELLS = 250_000
#: Most straight pieces of the `voom` trend.
TREND_BINS = 1000


def lm_fit(cells: DataFrame, enc: Encoded, contrast: np.ndarray) -> tuple[DataFrame, int]:
    """(feature_id, mean, effect, stdev_unscaled, sigma2), residual df. One shuffle by feature gives
    the moments and X'y; absent cells are zeros. Residuals come from centred sums, so large means
    do not cost digits."""
    p = enc.width
    xtx = cross_products(enc.rows, "x", p)
    if matrix_rank(xtx) < p:
        raise ValueError("The design matrix is rank deficient.")
    samples = int(round(xtx[0, 0]))
    df = samples - p
    if df < 1:
        raise ValueError("The model leaves no residual degrees of freedom.")
    inverse, ones = np.linalg.inv(xtx), xtx[0]
    scale = math.sqrt(float(contrast @ inverse @ contrast))
    x, y = F.col("x"), F.col("value")
    sums = spread_join(cells, enc.rows, ["sample_id"], "feature_id").groupBy("feature_id").agg(
        F.count("value").alias("k"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"),
        F.array(*[F.sum(x[i] * y) for i in range(p)]).alias("xty"))

    def solve(batches):
        for batch in batches:
            if not len(batch):
                continue
            xty = np.stack(batch["xty"].to_numpy()).astype(float)
            k, m, v = (batch[c].to_numpy(float) for c in ("k", "m", "v"))
            mean = k * m / samples
            total = k * v + k * (samples - k) / samples * m * m
            centred = xty - mean[:, None] * ones[None, :]
            explained = np.einsum("fi,ij,fj->f", centred, inverse, centred)
            yield pd.DataFrame({
                "feature_id": batch["feature_id"], "mean": mean, "effect": xty @ (inverse @ contrast), "stdev_unscaled": scale,
                "sigma2": np.maximum(total - explained, 0.0) / df})

    return sums.mapInPandas(solve, "feature_id string, mean double, effect double, stdev_unscaled double, sigma2 double"), df


def natural_spline(x: Column, knots: list[float]) -> list[Column]:
    """Natural cubic basis for the given knots (ends included): 1, x, and one per inner knot."""
    last = knots[-1]

    def cubed(k: float) -> Column:
        return F.pow(F.greatest(x - F.lit(k), F.lit(0.0)), F.lit(3.0))

    def d(k: float) -> Column:
        return (cubed(k) - cubed(last)) / F.lit(last - k)

    return [F.lit(1.0), x, *[d(k) - d(knots[-2]) for k in knots[:-2]]]


def ebayes(fit: DataFrame, df: int, trend: bool = False) -> DataFrame:
    """Moderated statistics (Smyth 2004): prior df and variance from the moments of log variances,
    optionally along mean abundance. Adds df_prior, s2_post, df_total, statistic, p_value."""
    fit, prior_df, log_prior = squeeze(fit, df, trend)
    pooled = float(df) * fit.count()
    if math.isinf(prior_df):
        post, total = F.exp(log_prior), pooled
    else:
        post = (F.lit(prior_df) * F.exp(log_prior) + F.lit(float(df)) * F.col("sigma2")) / F.lit(prior_df + df)
        total = min(prior_df + df, pooled)
    t = F.col("effect") / (F.col("stdev_unscaled") * F.sqrt("s2_post"))
    return (
        fit.withColumn("s2_post", post).withColumn("df_prior", F.lit(prior_df)).withColumn("df_total", F.lit(float(total)))
        .withColumn("statistic", t).withColumn("p_value", t_pvalue(F.col("statistic"), F.col("df_total")))
        .withColumn("standard_error", F.col("stdev_unscaled") * F.sqrt("sigma2")))


def squeeze(fit: DataFrame, df: int, trend: bool = False, variance: str = "sigma2", covariate: str = "mean"):
    """(fit, prior df, log prior variance column) of a scaled inverse chi-square prior."""
    floor = one_row(fit, medians(fit, [], variance, "_median"))
    z = F.log(F.greatest(variance, F.col("_median") * 1e-5, F.lit(1e-300)))
    rows = floor.withColumn("_e", z - F.lit(digamma(df / 2) - math.log(df / 2))).drop("_median")
    usable = rows.count()
    width = 1 + (usable >= 3) + (usable >= 6) + (usable >= 30) if trend else 1
    if width < 2:
        centre, spread = rows.agg(F.avg("_e"), F.var_samp("_e")).first()
        fitted = F.lit(centre)
    else:
        probs = {f"k{i}": i / (width - 1) for i in range(width)}
        ends = quantiles(rows, [], covariate, probs).first()
        knots = sorted({float(ends[k]) for k in probs})
        if len(knots) < 2:
            centre, spread = rows.agg(F.avg("_e"), F.var_samp("_e")).first()
            fitted = F.lit(centre)
        else:
            low, span = knots[0], knots[-1] - knots[0]
            basis = natural_spline((F.col(covariate) - F.lit(low)) / F.lit(span), [(k - low) / span for k in knots])
            width = len(basis)
            sums = cross_products(rows.select(F.array(*basis, F.col("_e")).alias("z")), "z", width + 1)
            beta = np.linalg.lstsq(sums[:width, :width], sums[:width, width], rcond=None)[0]
            fitted = sum((F.lit(float(b)) * c for b, c in zip(beta, basis)), F.lit(0.0))
            residual = float(sums[width, width] - 2 * beta @ sums[:width, width] + beta @ sums[:width, :width] @ beta)
            spread = max(residual, 0.0) / max(usable - width, 1)
    excess = (spread or 0.0) - trigamma(df / 2)
    if excess <= 0:
        return rows.drop("_e"), math.inf, fitted
    prior_df = 2 * trigamma_inverse(excess)
    return rows.drop("_e"), prior_df, fitted + F.lit(digamma(prior_df / 2) - math.log(prior_df / 2))


def bh_adjust(df: DataFrame, p: str = "p_value", by: list[str] | None = None, name: str = "adjusted_p_value", rows_per_task: int | None = None) -> DataFrame:
    """Benjamini-Hochberg per group of tests. Equal p-values share one row until the end, so the
    running minimum goes over distinct values; NULL p-values stay NULL."""
    by = by or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_k"))
    sizes = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    placed = running(counts, by, [p], ["_k"], rows_per_task)
    placed = placed.join(sizes, by) if by else one_row(placed, sizes)
    raw = placed.withColumn("_q", F.col(p) * F.col("_n") / (F.col("_k_before") + F.col("_k")))
    smallest = suffix_min(raw, by, [p], "_q", "_min", rows_per_task)
    adjusted = smallest.select(*by, p, "_k", F.least("_min", F.lit(1.0)).alias(name))
    return counted_join(df, adjusted, [*by, p], "_k", "left", rows_per_task).drop("_k")


# ---- dense blocks of features


def dense_blocks(cells: DataFrame, samples: list[str], work, schema: str, extra: DataFrame | None = None) -> DataFrame:
    """Apply `work(feature_ids, matrix, extra_frame)` to blocks of whole features, as a features x
    samples array with zeros for absent cells. A block holds about `DENSE_CELLS` cells, one feature
    at least. `extra` brings per-feature columns along."""
    def matrix(features, codes, columns, values):
        out = np.zeros((features, len(samples)))
        out[codes, columns] = values
        return out

    features = cells.select("feature_id").distinct().count()
    return _blocks(cells, samples, features * len(samples), matrix, work, schema, extra)


def sparse_blocks(cells: DataFrame, samples: list[str], width: int, work, schema: str, extra: DataFrame | None = None) -> DataFrame:
    """`dense_blocks` for work that needs only the cells that are not zero, and `width` numbers a feature: a block holds about `DENSE_CELLS`
    of either, and `work` gets `Counts` for the matrix."""
    def listed(features, codes, columns, values):
        some = values != 0
        return Counts(features, codes[some], columns[some], values[some])

    features, present = cells.agg(F.count_distinct("feature_id"), F.count(F.lit(1))).first()
    return _blocks(cells, samples, max(features * width, present), listed, work, schema, extra)


def _blocks(cells: DataFrame, samples: list[str], total: int, build, work, schema: str, extra: DataFrame | None) -> DataFrame:
    blocks = max(1, -(-total // DENSE_CELLS))
    position = pd.Series(np.arange(len(samples)), index=samples)
    rows = cells.select("feature_id", "sample_id", F.col("value").cast("double").alias("value"))
    extra_columns = [c for c in extra.columns if c != "feature_id"] if extra is not None else []
    if extra is not None:
        rows = spread_join(rows, extra, ["feature_id"], "sample_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(frame["feature_id"], sort=True)
        columns = position.reindex(frame["sample_id"]).to_numpy()
        known = ~np.isnan(columns)
        block = build(len(names), codes[known], columns[known].astype(int), frame["value"].to_numpy()[known])
        side = frame.drop_duplicates("feature_id").set_index("feature_id").loc[names, extra_columns] if extra_columns else None
        return work(np.asarray(names, dtype=object), block, side)

    keyed = rows.withColumn("_block", F.pmod(F.xxhash64("feature_id"), F.lit(blocks)))
    return keyed.groupBy("_block").applyInPandas(lambda f: run(f.drop(columns="_block")), schema)


def collect_design(enc: Encoded, per_sample: DataFrame | None = None) -> tuple[list[str], np.ndarray, np.ndarray | None]:
    """Design rows on the driver: samples x model columns, which a count model needs whole per
    feature. One further number per sample may come along."""
    rows = enc.rows if per_sample is None else enc.rows.join(per_sample, "sample_id")
    frame = rows.toPandas().sort_values("sample_id")
    extra = None if per_sample is None else frame.iloc[:, 2].to_numpy(float)
    return list(frame["sample_id"]), np.stack(frame["x"].to_numpy()).astype(float), extra


def _lowess(x: np.ndarray, y: np.ndarray, weights: np.ndarray, span: float = 0.5, rounds: int = 3) -> np.ndarray:
    """Robust local lines over sorted binned points."""
    n = len(x)
    k = max(2, int(math.ceil(span * n)))
    robust, fit = np.ones(n), y.copy()
    for _ in range(rounds + 1):
        for i in range(n):
            distance = np.abs(x - x[i])
            reach = max(np.partition(distance, min(k, n) - 1)[min(k, n) - 1], 1e-12) * 1.0001
            w = np.clip(1 - (distance / reach) ** 3, 0, None) ** 3 * robust * weights
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            sxx = np.sum(w * (x - mx) ** 2)
            slope = np.sum(w * (x - mx) * (y - my)) / sxx if sxx > 1e-12 * max(np.sum(w), 1e-300) else 0.0
            fit[i] = my + slope * (x[i] - mx)
        away = np.abs(y - fit)
        cut_off = 6 * np.median(away)
        if cut_off <= 1e-12:
            break
        robust = np.clip(1 - (away / cut_off) ** 2, 0, None) ** 2
    return fit


def smooth_trend(points: DataFrame, x: str, y: str, bins: int = TREND_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Local trend of y on x through the means of at most `bins` equal-count bins."""
    total = points.count()
    numbered = row_numbers(points.select(F.col(x).alias("x"), F.col(y).alias("y"), "feature_id"), [], ["x", "feature_id"])
    cell = F.floor((F.col("rn") - 1) * min(bins, total) / F.lit(float(total)))
    frame = numbered.groupBy(cell.alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("x")
    xs, ys = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
    return xs, _lowess(xs, ys, frame["n"].to_numpy(float))


def voom(counts: DataFrame, libraries: DataFrame, enc: Encoded, contrast: np.ndarray) -> DataFrame:
    """Precision-weighted moderated t (Law et al. 2014). `libraries` is (sample_id, size), already
    scaled by normalisation factors."""
    samples, x, size = collect_design(enc, libraries.select("sample_id", F.col("size").cast("double")))
    n, p = x.shape
    inverse = np.linalg.inv(x.T @ x)
    pairs = (x[:, :, None] * x[:, None, :]).reshape(n, p * p)

    def log_cpm(matrix):
        return np.log2((matrix + 0.5) / (size + 1)[None, :] * 1e6)

    def centre(names, mean, rss):
        return pd.DataFrame({"feature_id": names, "amean": mean, "sx": mean + np.mean(np.log2(size + 1)) - math.log2(1e6), "sy": np.sqrt(np.sqrt(rss / (n - p)))})

    def result(names, mean, beta, cov, rss):
        return pd.DataFrame({
            "feature_id": names, "mean": mean, "effect": beta @ contrast,
            "stdev_unscaled": np.sqrt(np.einsum("p,fpq,q->f", contrast, cov, contrast)), "sigma2": rss / (n - p)})

    def first(names, matrix, _):
        y = log_cpm(matrix)
        beta = y @ x @ inverse
        return centre(names, y.mean(1), ((y - beta @ x.T) ** 2).sum(1))

    def weigh(level):
        return np.maximum(np.interp(level, xs, ys), 1e-6) ** -4

    def second(names, matrix, _):
        y = log_cpm(matrix)
        fitted = y @ x @ inverse @ x.T
        level = np.log2(np.exp2(fitted) * 1e-6 * (size + 1)[None, :])
        w = weigh(level)
        xtwx = (w @ pairs).reshape(len(w), p, p)
        cov = np.linalg.inv(xtwx)
        beta = np.einsum("fpq,fq->fp", cov, (w * y) @ x)
        return result(names, y.mean(1), beta, cov, (w * (y - beta @ x.T) ** 2).sum(1))

    def first_of_counts(names, block, _):
        mean, _, rss = levels.plain(block)
        return centre(names, mean, rss)

    def second_of_counts(names, block, _):
        mean, fitted, _ = levels.plain(block)
        return result(names, mean, *levels.weighted(block, fitted, weigh))

    levels = LogLevels(x, size)

    def blocks(work, of_counts, schema, sparse):
        return sparse_blocks(counts, samples, len(levels.nodes), of_counts, schema) if sparse else dense_blocks(counts, samples, work, schema)

    plain = cut(blocks(first, first_of_counts, "feature_id string, amean double, sx double, sy double", levels.worthwhile))
    xs, ys = smooth_trend(plain, "sx", "sy")
    # the trend of fewer features has sharper corners than the bins follow, and their matrix is small
    fit = cut(blocks(second, second_of_counts, "feature_id string, mean double, effect double, stdev_unscaled double, sigma2 double",
                     levels.worthwhile and len(xs) >= TREND_BINS))
    return ebayes(fit, n - p)

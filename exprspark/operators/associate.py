"""Association of scores with a phenotype under adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.tails import f_upper, t_two_sided
from exprspark.operators.design import Design, cross_products, encode, matrix_rank
from exprspark.operators.linear import bh_adjust
from exprspark.operators.validate import profile_variables
from exprspark.session import cut

EPS = float(np.finfo(float).eps)
LARGEST = float(np.finfo(float).max)


def associate(scores: DataFrame, meta: DataFrame, phenotype: str, covariates: list[str] | None = None, block: str | None = None,
              kind: str = "auto") -> DataFrame:
    """Per set: slope or two-group t, or omnibus F for more groups, with BH over sets. `scores` is
    (set_id, sample_id, score) with every sample in every set."""
    covariates = covariates or []
    profile = {r["variable"]: r for r in profile_variables(meta.select("sample_id", phenotype)).collect()}[phenotype]
    kind = profile["kind"] if kind == "auto" else kind
    forced = [c for c in [block] if c] + ([phenotype] if kind == "categorical" else [])
    enc = encode(meta, Design([*covariates, *([block] if block else []), phenotype], categorical=forced))
    tested = [i for i, n in enumerate(enc.names) if n == phenotype or n.startswith(f"{phenotype}[")]
    xtx = cross_products(enc.rows, "x", enc.width)
    samples = int(round(xtx[0, 0]))
    df = samples - enc.width
    if matrix_rank(xtx) < enc.width:
        raise ValueError("The association design is rank deficient; remove confounded terms.")
    if df < 1:
        raise ValueError("The association leaves no residual degrees of freedom.")
    inverse, ones = np.linalg.inv(xtx), xtx[0]
    nuisance = [i for i in range(enc.width) if i not in tested]
    reduced = np.linalg.inv(xtx[np.ix_(nuisance, nuisance)])
    sxx = xtx[tested[0], tested[0]]
    test = ("adjusted_linear_regression" if kind == "numeric" else "adjusted_two_group_comparison") if len(tested) == 1 else "adjusted_omnibus_group_comparison"
    x, y = F.col("x"), F.col("score")
    sums = scores.join(enc.rows, "sample_id").groupBy("set_id").agg(
        F.avg("score").alias("m"), F.var_pop("score").alias("v"), F.array(*[F.sum(x[i] * y) for i in range(enc.width)]).alias("xty"))

    def solve(batches):
        for batch in batches:
            if not len(batch):
                continue
            xty = np.stack(batch["xty"].to_numpy()).astype(float)
            m, v = batch["m"].to_numpy(float), batch["v"].to_numpy(float)
            centred = xty - m[:, None] * ones[None, :]
            rss = np.maximum(samples * v - np.einsum("fi,ij,fj->f", centred, inverse, centred), 0.0)
            correlation = np.full(len(m), np.nan)
            if len(tested) == 1:
                effect = xty @ inverse[:, tested[0]]
                se = np.sqrt(np.maximum(rss / df * inverse[tested[0], tested[0]], 0.0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    statistic = np.where(se > EPS, effect / se, np.where(np.abs(effect) > EPS, np.copysign(LARGEST, effect), 0.0))
                    p = np.where(se > EPS, t_two_sided(np.where(se > EPS, effect / se, 0.0), df), np.where(np.abs(effect) > EPS, 0.0, 1.0))
                if kind == "numeric":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        correlation = np.where(np.sqrt(v) > EPS, centred[:, tested[0]] / np.sqrt(sxx * samples * v), np.nan)
            else:
                part = centred[:, nuisance]
                rss0 = np.maximum(samples * v - np.einsum("fi,ij,fj->f", part, reduced, part), 0.0)
                statistic = np.minimum(np.maximum((rss0 - rss) / len(tested), 0.0) / np.maximum(rss / df, np.finfo(float).tiny), LARGEST)
                effect, p = np.full(len(m), np.nan), f_upper(statistic, len(tested), df)
            yield pd.DataFrame({"set_id": batch["set_id"], "test": test, "effect": effect, "statistic": statistic, "p_value": p, "correlation": correlation})

    out = sums.mapInPandas(solve, "set_id string, test string, effect double, statistic double, p_value double, correlation double")
    out = out.withColumn("effect", F.nullif(F.col("effect"), F.lit(float("nan")))).withColumn("correlation", F.nullif(F.col("correlation"), F.lit(float("nan"))))
    # written once: the adjustment reads it several times and joins on the p-values
    return bh_adjust(cut(out), "p_value").withColumn("sample_count", F.lit(samples)).withColumn("degrees_of_freedom", F.lit(df))


def group_means(scores: DataFrame, meta: DataFrame, phenotype: str) -> DataFrame:
    joined = scores.join(meta.select("sample_id", F.col(phenotype).cast("string").alias("level")), "sample_id")
    return joined.groupBy("set_id", "level").agg(F.count(F.lit(1)).alias("sample_count"), F.avg("score").alias("score_mean"))

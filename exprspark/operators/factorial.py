"""Factorial experiments with repeated samples: sample blocks are absorbed, so the number of
biological samples never becomes a number of model columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.text import blank
from exprspark.operators.design import Design, cross_products, encode, matrix_rank
from exprspark.operators.experiments import NUMERIC_FIELDS, Z95
from exprspark.operators.validate import finding, union_all
from exprspark.session import cut


@dataclass
class Absorbed:
    names: list[str]
    products: np.ndarray  # within-sample cross products of the columns and the response
    means: DataFrame  # biological_sample_id, n, xm array, ym
    samples: int
    rows: int


def _absorb(rows: DataFrame, factors: list[str], interactions: list[tuple[str, str]], response: str | None) -> Absorbed:
    """Columns and response as deviations from their sample's mean."""
    categorical = [f for f in [*factors, "run"] if f not in NUMERIC_FIELDS]
    meta = rows.select(F.col("measurement_id").alias("sample_id"), *dict.fromkeys([*factors, "run"]))
    enc = encode(meta, Design([*factors, "run"], categorical=categorical, interactions=interactions))
    width = enc.width - 1
    y = F.col(response).cast("double") if response else F.lit(0.0)
    joined = rows.select(F.col("measurement_id").alias("sample_id"), "biological_sample_id", y.alias("y")).join(enc.rows, "sample_id")
    values = joined.select("biological_sample_id", F.concat(F.slice("x", 2, width), F.array("y")).alias("z"))
    means = values.groupBy("biological_sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("z")[i]) for i in range(width + 1)]).alias("m"))
    means = cut(means)
    within = values.join(means, "biological_sample_id").select(F.zip_with("z", "m", lambda a, b: a - b).alias("z"))
    products = cross_products(within, "z", width + 1)
    totals = means.agg(F.count(F.lit(1)), F.sum("n")).first()
    return Absorbed(enc.names[1:], products, means, totals[0], int(totals[1]))


def check_multifactor(rows: DataFrame, factors: list[str], interactions: list[tuple[str, str]] | None = None) -> DataFrame:
    """Findings of a two- or three-factor design with sample and run blocks; rows are the included
    measurements."""
    none = rows.sparkSession.range(1)
    parts = []
    if not 2 <= len(factors) <= 3 or len(set(factors)) != len(factors):
        parts.append(finding(none, "DESIGN.MULTIFACTOR_BOUNDS", ",".join(factors)))
    required = ["biological_sample_id", "run", *factors]
    empty = F.array_contains(F.array(*[blank(F.col(c).cast("string")) for c in required]), True)
    parts.append(finding(rows.where(empty), "ASSIGNMENT.MULTIFACTOR_METADATA_REQUIRED", F.col("measurement_id")))
    parts.append(finding(rows.groupBy("measurement_id").count().where("count > 1"), "ASSIGNMENT.DUPLICATE_MEASUREMENT", F.col("measurement_id")))
    parts.append(finding(rows.groupBy("biological_sample_id").count().where("count < 2"), "DESIGN.REPEATED_SAMPLES_REQUIRED", F.col("biological_sample_id")))
    levels = rows.agg(*[F.count_distinct(f).alias(f) for f in factors])
    parts += [finding(levels.where(F.col(f) < 2), "DESIGN.FACTOR_LEVELS_INSUFFICIENT", f) for f in factors]
    rank, columns, count = multifactor_rank(rows, factors, interactions or [])
    if rank < columns:
        parts.append(finding(none, "DESIGN.MULTIFACTOR_RANK_DEFICIENT", f"{rank} of {columns}"))
    if count - rank < 3 or count < 2 * columns:
        parts.append(finding(none, "DESIGN.MULTIFACTOR_TOO_SPARSE", f"{count} for {columns}"))
    thin = rows.groupBy(*factors).count().where("count < 2")
    parts.append(finding(thin, "DESIGN.MULTIFACTOR_THIN_CELLS", F.concat_ws("/", *[F.col(f).cast("string") for f in factors]), "WARNING"))
    return union_all(parts)


def multifactor_rank(rows: DataFrame, factors: list[str], interactions: list[tuple[str, str]]) -> tuple[int, int, int]:
    """(rank, columns, measurements) of factors, interactions, sample and run blocks together."""
    a = _absorb(rows, factors, interactions, None)
    q = len(a.names)
    return matrix_rank(a.products[:q, :q]) + a.samples, q + a.samples, a.rows


def multifactor_fit(rows: DataFrame, factors: list[str], response: str, interactions: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms with standard errors and intervals, variance row, cell means). The effects of sample
    blocks follow from the sample means and the within-sample coefficients."""
    a = _absorb(rows, factors, interactions or [], response)
    q = len(a.names)
    inner = a.products[:q, :q]
    if matrix_rank(inner) < q:
        raise ValueError("The factors, interactions and runs are not identifiable within samples.")
    v = np.linalg.inv(inner)
    beta = v @ a.products[:q, q]
    df = a.rows - q - a.samples
    if df < 1:
        raise ValueError("The model leaves no residual degrees of freedom.")
    rss = max(float(a.products[q, q] - beta @ a.products[:q, q]), 0.0)
    s2 = rss / df
    spark = rows.sparkSession
    base = a.means.orderBy("biological_sample_id").first()
    x0, y0, n0 = np.asarray(base["m"][:q]), base["m"][q], base["n"]
    start = float(y0 - x0 @ beta)
    named = [("intercept", start, float(np.sqrt(s2 * (1 / n0 + x0 @ v @ x0))))]
    named += [(n, float(b), float(np.sqrt(max(s2 * v[i, i], 0.0)))) for i, (n, b) in enumerate(zip(a.names, beta))]
    model_terms = spark.createDataFrame(named, "term string, estimate double, standard_error double")

    def blocks(batches):
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack(batch["m"].to_numpy()).astype(float)
            gap = m[:, :q] - x0[None, :]
            estimate = m[:, q] - m[:, :q] @ beta - start
            se = np.sqrt(s2 * (1 / batch["n"].to_numpy(float) + 1 / n0 + np.einsum("si,ij,sj->s", gap, v, gap)))
            yield pd.DataFrame({"term": "biological_sample_id[" + batch["biological_sample_id"] + "]", "estimate": estimate, "standard_error": se})

    others = a.means.where(F.col("biological_sample_id") != base["biological_sample_id"])
    terms = model_terms.unionByName(others.mapInPandas(blocks, "term string, estimate double, standard_error double"))
    half = Z95 * F.col("standard_error")
    terms = terms.withColumn("lower", F.col("estimate") - half).withColumn("upper", F.col("estimate") + half)
    variance = a.means.agg(F.var_samp(F.col("m")[q]).alias("between_biological_sample")).withColumn(
        "model_residual", F.lit(rss / (a.rows - 1))).withColumn("residual_df", F.lit(df))
    cells = rows.groupBy(*factors).agg(F.count(F.lit(1)).alias("measurement_count"), F.avg(response).alias("mean_expression"))
    return terms, variance, cells

"""Differential result tables: calls, annotation, plots' point tables, pages and feature detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import medians, one_row, row_numbers
from exprspark.operators.matrix import feature_moments

TINY = 2.2250738585072014e-308  # fixed value: smallest normal double


def call_significant(de: DataFrame, fdr: float = 0.05, change: float = 1.0) -> DataFrame:
    hit = (F.col("adjusted_p_value") <= fdr) & (F.abs("log2_fold_change") >= change)
    return de.withColumn("significant", F.coalesce(hit, F.lit(False)))


def result_order() -> list[Column]:
    """Adjusted p-value with missing last, larger change first, then id."""
    return [F.asc_nulls_last("adjusted_p_value"), F.desc_nulls_last(F.abs("log2_fold_change")), F.asc("feature_id")]


def annotate_de(de: DataFrame, feat: DataFrame, contrast: str, method: str) -> DataFrame:
    symbols = feat.select("feature_id", F.coalesce("symbol", F.lit("")).alias("gene_symbol"))
    return de.join(symbols, "feature_id", "left").select(
        "*", F.lit(contrast).alias("contrast"), F.lit(method).alias("method")).withColumn("gene_symbol", F.coalesce("gene_symbol", F.lit("")))


def p_histogram(de: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1], empty bins included, with finite and missing totals."""
    p = F.col("p_value")
    finite = p.isNotNull() & ~F.isnan(p)
    counts = de.where(finite).groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    totals = de.agg(F.count_if(finite).alias("finite_p_value_count"), F.count_if(~finite).alias("missing_p_value_count"))
    every = de.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return one_row(every.join(counts, "bin", "left"), totals).select(
        "bin", (F.col("bin") / bins).alias("start"), ((F.col("bin") + 1) / bins).alias("end"),
        F.coalesce("count", F.lit(0)).alias("count"), "finite_p_value_count", "missing_p_value_count")


def heatmap_block(de: DataFrame, cells: DataFrame, meta: DataFrame, variable: str, denominator: str, numerator: str,
                  block: str | None = None, top: int = 30) -> DataFrame:
    """z-scores of the first `top` features over all samples, with feature and sample positions.
    Absent cells are zeros: the few chosen features meet the sample list once."""
    chosen = de.orderBy(*result_order()).limit(top)
    ranked = row_numbers(
        chosen.withColumn("_a", F.coalesce("adjusted_p_value", F.lit(2.0))).withColumn("_c", -F.coalesce(F.abs("log2_fold_change"), F.lit(-1.0))),
        [], ["_a", "_c", "feature_id"], "feature_order").select("feature_id", "feature_order")
    level = F.col(variable).cast("string")
    place = F.when(level == denominator, 1).when(level == numerator, 2).otherwise(3)
    keyed = meta.select("sample_id", (F.col(block).cast("string") if block else F.lit("")).alias("_block"), place.alias("_place"))
    ordered = row_numbers(keyed, [], ["_block", "_place", "sample_id"], "sample_order").select("sample_id", "sample_order")
    sizes = meta.agg(F.count(F.lit(1)).alias("_n")).first()[0]
    shown = cells.join(F.broadcast(ranked), "feature_id")  # at most `top` features
    moments = feature_moments(shown.select("feature_id", "sample_id", "value"), sizes)
    sd = F.when(F.col("var_samp") > 0, F.sqrt("var_samp")).otherwise(1.0)
    rows = ranked.join(moments, "feature_id").withColumn("_sd", sd)
    grid = ordered.crossJoin(F.broadcast(rows))  # top x samples: the block itself
    return grid.join(shown.select("feature_id", "sample_id", "value"), ["feature_id", "sample_id"], "left").select(
        "feature_id", "sample_id", "feature_order", "sample_order", ((F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("_sd")).alias("z"))


def effect_points(de: DataFrame, abundance: str) -> DataFrame:
    """Volcano and mean-difference coordinates of every feature."""
    floor = F.when(F.col("p_value").isNotNull(), F.greatest("p_value", F.lit(TINY)))
    return de.select("feature_id", F.col("log2_fold_change").alias("volcano_x"), (-F.log10(floor)).alias("volcano_y"),
                     F.col(abundance).alias("ma_x"), F.col("log2_fold_change").alias("ma_y"), "adjusted_p_value", "significant")


def filter_results(de: DataFrame, search: str | None = None, fdr_max: float | None = None, change_min: float | None = None, significant_only: bool = False) -> DataFrame:
    out = de
    text = (search or "").strip().lower()
    if text:
        out = out.where(F.lower("feature_id").contains(text) | F.lower(F.coalesce("gene_symbol", F.lit(""))).contains(text))
    if fdr_max is not None:
        out = out.where(F.col("adjusted_p_value") <= fdr_max)
    if change_min is not None:
        out = out.where(F.abs("log2_fold_change") >= change_min)
    return out.where("significant") if significant_only else out


def result_page(de: DataFrame, sort_by: str = "adjusted_p_value", descending: bool = False, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """One page with the number of matching rows. Missing sort values come last, by id."""
    matching = filter_results(de, **filters)
    key = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    page = matching.orderBy(key, "feature_id").offset(offset).limit(limit)
    return one_row(page, matching.agg(F.count(F.lit(1)).alias("total")))


def feature_detail(de: DataFrame, cells: DataFrame, meta: DataFrame, feature_id: str, variable: str, denominator: str, numerator: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result row, value per sample, summary per level with the contrast's levels first)."""
    one = cells.where(F.col("feature_id") == feature_id)
    level = F.coalesce(F.col(variable).cast("string"), F.lit("Unavailable"))
    values = meta.select("sample_id", level.alias("level")).join(one.select("sample_id", "value"), "sample_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    place = F.when(F.col("level") == denominator, 0).when(F.col("level") == numerator, 1).otherwise(2)
    summary = values.groupBy("level").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    summary = summary.join(medians(values, ["level"], "value"), "level").withColumn("place", place)
    return de.where(F.col("feature_id") == feature_id), values, summary

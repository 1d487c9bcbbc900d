"""Gene-set enrichment of a differential result. sets: (set_id, feature_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.draws import draw_wide
from exprspark.functions.ordering import one_row, row_numbers, running
from exprspark.functions.tails import hypergeometric_pvalue
from exprspark.operators.linear import bh_adjust
from exprspark.operators.results import TINY
from exprspark.session import cut


# sums in another order differ by this much: such extremes are equal, and equal ones count as up
ROUNDING = 1e-12


def rank_features(de: DataFrame) -> DataFrame:
    """(feature_id, score, position): signed -log10 p, largest first, ties by id."""
    p, change = F.col("p_value"), F.col("log2_fold_change")
    usable = p.isNotNull() & ~F.isnan(p) & change.isNotNull() & ~F.isnan(change)
    score = F.signum(change) * -F.log10(F.greatest(p, F.lit(TINY)))
    rows = de.where(usable).select("feature_id", (score + 0.0).alias("score")).withColumn("_down", -F.col("score"))
    return row_numbers(rows, [], ["_down", "feature_id"], "position").drop("_down")


def eligible_sets(sets: DataFrame, features: DataFrame, minimum: int, maximum: int) -> DataFrame:
    """Distinct members found among the features, of sets whose found size is in range. The set
    sizes are joined back, so a large set is never gathered."""
    found = sets.select("set_id", "feature_id").distinct().join(features.select("feature_id").distinct(), "feature_id", "left_semi")
    sizes = found.groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size")).where(F.col("set_size").between(minimum, maximum))
    return found.join(sizes, "set_id")


def running_extremes(hits: DataFrame, by: list[str]) -> DataFrame:
    """Extremes of the running sum per group from its hits alone: between two hits the sum only
    falls, so its highs are at hits and its lows just before them. hits: by, position, weight,
    set_size, feature_count."""
    totals = hits.groupBy(*by).agg(F.sum("weight").alias("_w"))
    rows = hits.join(totals, by)
    flat = F.col("_w") == 0
    rows = rows.withColumn("_one", F.lit(1)).withColumn("_step", F.when(flat, 1.0 / F.col("set_size")).otherwise(F.col("weight") / F.col("_w")))
    placed = running(rows, by, ["position"], ["_step", "_one"])
    # a set of all features has no misses
    misses = F.coalesce(F.try_divide(F.col("position") - 1 - F.col("_one_before"), F.col("feature_count") - F.col("set_size")), F.lit(0.0))
    low = F.col("_step_before") - misses
    return placed.withColumn("low", low).withColumn("high", low + F.col("_step"))


def gsea_score(ranks: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(score and direction per set, leading-edge rows). members come from `eligible_sets`."""
    total = ranks.agg(F.count(F.lit(1)).alias("feature_count"))
    hits = one_row(members.join(ranks, "feature_id"), total).withColumn("weight", F.abs("score"))
    placed = cut(running_extremes(hits, ["set_id"]))
    extremes = placed.groupBy("set_id").agg(
        F.max("set_size").alias("set_size"), F.max("feature_count").alias("feature_count"),
        F.min(F.struct(-F.col("high"), F.col("position"))).alias("_top"), F.min(F.struct(F.col("low"), F.col("position"))).alias("_bottom"))
    high, low = -F.col("_top.col1"), F.col("_bottom.low")
    whole = F.col("set_size") == F.col("feature_count")
    up = F.abs(high) >= F.abs(low) - ROUNDING
    scored = extremes.select(
        "set_id", "set_size", F.when(whole, 0.0).when(up, high).otherwise(low).alias("enrichment_score"),
        F.when(whole, F.lit(None)).when(up, F.col("_top.position")).otherwise(F.col("_bottom.position")).alias("_edge"), up.alias("_up"))
    edge = placed.select("set_id", "feature_id", "position").join(scored.select("set_id", "_edge", "_up"), "set_id").where(
        F.when(F.col("_up"), F.col("position") <= F.col("_edge")).otherwise(F.col("position") >= F.col("_edge"))).select("set_id", "feature_id", "position")
    direction = F.when(F.col("enrichment_score") >= 0, "up").otherwise("down")
    return scored.drop("_edge", "_up").withColumn("direction", direction), edge


def gsea_permute(ranks: DataFrame, members: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Same-direction permutation p and normalised score per set. Labels are shuffled by a hash of
    (seed, permutation, feature); the weight stays with the position, and only the members of the
    sets travel on from each shuffle."""
    observed, _ = gsea_score(ranks, members)
    total = ranks.agg(F.count(F.lit(1)).alias("feature_count"))
    shuffled = ranks.select("feature_id", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("permutation"))
    shuffled = shuffled.withColumn("_key", draw_wide(seed, F.col("permutation"), F.col("feature_id")))
    places = row_numbers(shuffled, ["permutation"], ["_key", "feature_id"], "position")
    weights = ranks.select("position", F.abs("score").alias("weight"))
    wanted = members.join(places.drop("_key"), "feature_id").join(weights, "position")
    nulls = running_extremes(one_row(wanted, total), ["set_id", "permutation"]).groupBy("set_id", "permutation").agg(
        F.max("high").alias("_h"), F.min("low").alias("_l"))
    score = F.when(F.abs("_h") >= F.abs("_l") - ROUNDING, F.col("_h")).otherwise(F.col("_l"))
    nulls = nulls.select("set_id", score.alias("null_score"))
    es, ns = F.col("enrichment_score"), F.col("null_score")
    same = F.when(es >= 0, ns >= 0).otherwise(ns < 0)
    beyond = same & F.when(es >= 0, ns >= es).otherwise(ns <= es)
    per = nulls.join(observed, "set_id").groupBy("set_id").agg(
        F.max("set_size").alias("set_size"), F.max(es).alias("enrichment_score"), F.max("direction").alias("direction"),
        F.count_if(same).alias("_same"), F.count_if(beyond).alias("_beyond"), F.avg(F.when(same, F.abs(ns))).alias("_scale"))
    normal = F.when((F.col("_same") > 0) & (F.col("_scale") > 0), es / F.col("_scale")).otherwise(0.0)
    return per.select("set_id", "set_size", "direction", "enrichment_score", normal.alias("normalized_enrichment_score"),
                      ((F.col("_beyond") + 1) / (F.col("_same") + 1)).alias("p_value"))


def ora(de: DataFrame, sets: DataFrame, minimum: int, maximum: int) -> tuple[DataFrame, DataFrame]:
    """(over-representation of the significant features per set, overlap rows)."""
    universe = de.select("feature_id", "significant", "log2_fold_change").dropDuplicates(["feature_id"])
    members = eligible_sets(sets, universe, minimum, maximum)
    sizes = universe.agg(F.count(F.lit(1)).alias("_u"), F.count_if("significant").alias("_f"))
    joined = members.join(universe, "feature_id")
    change = F.when(F.col("significant") & ~F.isnan("log2_fold_change"), F.col("log2_fold_change"))
    per = one_row(joined.groupBy("set_id").agg(
        F.max("set_size").alias("set_size"), F.count_if("significant").alias("overlap_size"), F.avg(change).alias("_mean")), sizes)
    a = F.col("overlap_size")
    b, c = F.col("_f") - a, F.col("set_size") - a
    d = F.col("_u") - a - b - c
    direction = F.when(F.col("_mean") > 0, "up").when(F.col("_mean") < 0, "down").otherwise("mixed")
    out = per.select(
        "set_id", direction.alias("direction"), "set_size", "overlap_size", ((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))).alias("odds_ratio"),
        hypergeometric_pvalue(a.cast("double"), F.col("set_size").cast("double"), (F.col("_u") - F.col("set_size")).cast("double"), F.col("_f").cast("double")).alias("p_value"))
    return out, joined.where("significant").select("set_id", "feature_id")


def finish_enrichment(results: DataFrame, effect: str, fdr: float = 0.05) -> DataFrame:
    """Adjusted p-values over the sets, calls, and the published order as `rank`."""
    adjusted = bh_adjust(results, "p_value").withColumn("significant", F.col("adjusted_p_value") <= fdr)
    keyed = adjusted.withColumn("_e", -F.abs(F.coalesce(F.nanvl(F.col(effect), F.lit(0.0)), F.lit(0.0))))
    return row_numbers(keyed, [], ["adjusted_p_value", "_e", "set_id"], "rank").drop("_e")

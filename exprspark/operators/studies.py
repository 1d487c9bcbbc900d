"""Studies of a locked model: precision, bridging, ordered levels, robustness, and criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprspark.functions.ordering import one_row
from exprspark.operators.experiments import half_width, pair_sides


def score_assignments(predictions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Predictions joined one to one to the included assignments, with the rows that fail to match
    marked. predictions: (sample_id, score, call)."""
    named = predictions.select(F.col("sample_id").alias("measurement_id"), F.col("score").alias("score"), F.col("call").alias("call"), F.lit(True).alias("_p"))
    joined = assignments.withColumn("_a", F.lit(True)).join(named, "measurement_id", "full_outer")
    status = F.when(F.col("_a").isNull(), "unexpected").when(F.col("_p").isNull(), "missing").otherwise("matched")
    return joined.withColumn("match", status).drop("_a", "_p")


def require_matched(scored: DataFrame) -> DataFrame:
    bad = scored.where("match <> 'matched'").first()
    if bad is not None:
        raise ValueError(f"Assignments and predictions disagree at '{bad['measurement_id']}' ({bad['match']}).")
    return scored.drop("match")


def precision_metrics(rows: DataFrame) -> DataFrame:
    """Variance components of repeated measurements by the method of moments; rows have
    biological_sample_id and score."""
    per = rows.groupBy("biological_sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v"))
    parts = per.agg(
        F.count(F.lit(1)).alias("biological_sample_count"), F.avg(F.when(F.col("n") > 1, F.col("v"))).alias("within"),
        F.avg("n").alias("replicates"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("observed"))
    overall = rows.agg(F.count(F.lit(1)).alias("measurement_count"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
    between = F.greatest(F.lit(0.0), F.col("observed") - F.col("within") / F.col("replicates"))
    total = between + F.col("within")
    return one_row(overall, parts).select(
        "measurement_count", "biological_sample_count", "mean", "sd", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")).alias("cv"),
        F.sqrt("within").alias("repeatability_sd"), F.sqrt(total).alias("reproducibility_sd"), between.alias("between_variance"),
        F.col("within").alias("repeatability_variance"), total.alias("total_variance"), F.when(total > 0, between / total).alias("icc"))


def within_sample_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("biological_sample_id").agg((F.max("score") - F.min("score")).alias("range"))


def call_stability(rows: DataFrame) -> DataFrame:
    """Per sample: share of its modal call, and agreeing and total pairs counted, not listed."""
    counts = rows.groupBy("biological_sample_id", "call").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("biological_sample_id").agg(
        (F.max("n") / F.sum("n")).alias("agreement"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("stable_pairs"),
        (F.sum("n") * (F.sum("n") - 1) / 2).alias("total_pairs"))


def call_agreement(rows: DataFrame) -> DataFrame:
    return call_stability(rows).agg(
        F.sum("stable_pairs").alias("stable_pairs"), F.sum("total_pairs").alias("total_pairs"),
        F.when(F.sum("total_pairs") > 0, F.sum("stable_pairs") / F.sum("total_pairs")).alias("categorical_agreement"))


def near_threshold(rows: DataFrame, threshold: float, band: float, columns: tuple[str, ...] = ("score",)) -> DataFrame:
    """Rows with a score within `band` of the threshold (any of the given scores)."""
    distance = [F.abs(F.col(c) - threshold) for c in columns]
    return rows.where((F.least(*distance) if len(distance) > 1 else distance[0]) <= band)


def bridge_pairs(rows: DataFrame, reference: str, comparator: str, extra: list[str] | None = None) -> DataFrame:
    """Reference and comparator scores and calls of every biological sample."""
    pairs = pair_sides(rows, reference, comparator, ["measurement_id", "score", "call", *(extra or [])])
    c, ref = F.col("comparator_score"), F.col("reference_score")
    agree = F.col("comparator_call") == F.col("reference_call")
    return pairs.withColumn("difference", c - ref).withColumn("average", (c + ref) / 2).withColumn("call_agreement", agree)


def deming(pairs: DataFrame, x: str = "reference_score", y: str = "comparator_score") -> DataFrame:
    """Errors-in-both regression with variance ratio 1; not estimable at zero covariance."""
    s = pairs.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("sxx"), F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"))
    gap = F.col("syy") - F.col("sxx")
    slope = F.when(F.col("sxy") != 0, (gap + F.sqrt(gap * gap + 4 * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy")))
    return s.select(F.when(F.col("sxy") != 0, "ESTIMATED").otherwise("NOT_ESTIMABLE").alias("status"), slope.alias("slope"),
                    (F.col("my") - slope * F.col("mx")).alias("intercept"))


def bridge_metrics(pairs: DataFrame, margin: float) -> DataFrame:
    """Bias, interval, agreement limits, correlation, equivalence rule and call agreement."""
    half, sd, bias = half_width("difference"), F.stddev_samp("difference"), F.avg("difference")
    r, c = "reference_score", "comparator_score"
    varied = (F.stddev_pop(r) > 0) & (F.stddev_pop(c) > 0)
    return pairs.agg(
        F.count(F.lit(1)).alias("pair_count"), bias.alias("paired_bias"), sd.alias("paired_bias_sd"),
        (bias - half).alias("lower"), (bias + half).alias("upper"), (bias - 1.96 * sd).alias("lower_limit"), (bias + 1.96 * sd).alias("upper_limit"),
        F.when(varied, F.corr(r, c)).alias("profile_correlation"), F.avg(F.col("call_agreement").cast("double")).alias("categorical_agreement"),
        F.avg((~F.col("call_agreement")).cast("double")).alias("discordance_rate"),
        ((bias - half > -margin) & (bias + half < margin)).alias("equivalent"))


def subgroup_review(pairs: DataFrame, subgroup: str) -> DataFrame:
    return pairs.where(F.coalesce(F.col(subgroup).cast("string"), F.lit("")) != "").groupBy(F.col(subgroup).alias("subgroup")).agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg("difference").alias("mean_paired_bias"),
        F.avg(F.col("call_agreement").cast("double")).alias("categorical_agreement"))


def level_rows(rows: DataFrame, reference: float) -> DataFrame:
    """Each measurement against the same sample's reference level; where the sample has none, differences and agreement are null."""
    ref = rows.where(F.col("level") == reference).select(
        "biological_sample_id", F.col("score").alias("reference_score"), F.col("call").alias("reference_call"))
    gap = F.col("score") - F.col("reference_score")
    return rows.join(ref, "biological_sample_id", "left").withColumn("difference", gap).withColumn("absolute_difference", F.abs(gap)).withColumn(
        "call_agreement", F.col("call") == F.col("reference_call"))


def level_metrics(rows: DataFrame, reference: float) -> DataFrame:
    """Per level: differences to the reference with interval, agreement, crossings, QC failures. Measurements of samples
    without a reference level count in the mean score and in `unpaired_count`, and in nothing that needs a pair."""
    half, mean = half_width("difference"), F.avg("difference")
    return level_rows(rows, reference).groupBy("level").agg(
        F.count(F.lit(1)).alias("measurement_count"), F.count_if(F.col("difference").isNull()).alias("unpaired_count"),
        F.avg("score").alias("mean_score"), mean.alias("mean_score_difference"),
        F.avg("absolute_difference").alias("mean_absolute_score_difference"), (mean - half).alias("lower"), (mean + half).alias("upper"),
        F.avg(F.col("call_agreement").cast("double")).alias("call_agreement_to_reference"),
        F.count_if(~F.col("call_agreement")).alias("threshold_crossing_count"), F.avg(F.col("qc_failure").cast("double")).alias("qc_failure_rate"))


def trend_and_change(levels: DataFrame) -> DataFrame:
    """Slope of level means on the level, and the largest step between neighbours. One row per
    ordered level goes through the window."""
    down = Window.orderBy(F.desc("level"))
    steps = levels.select("level", F.lead("level").over(down).alias("lower_level"), F.abs(F.lead("mean_score").over(down) - F.col("mean_score")).alias("change"))
    largest = steps.where("lower_level is not null").agg(
        F.max_by(F.struct(F.col("level").alias("upper_level"), "lower_level", F.col("change").alias("largest_change")), F.struct("change", "level")).alias("s")).select("s.*")
    return one_row(levels.agg(F.regr_slope("mean_score", "level").alias("slope")), largest)


# Which endpoint a level criterion must name, and the direction that passes.
LEVEL_CRITERIA = {
    "mean_absolute_score_difference": ("classifier_score", "lte"),
    "call_agreement_to_reference": ("predicted_class", "gte"),
    "qc_failure_rate": ("qc_failure", "lte"),
}


def level_criteria(levels: DataFrame, criteria: DataFrame, reference: float) -> DataFrame:
    """(criterion rows with status and number of passing levels). criteria: criterion_id, metric,
    endpoint, operator (all_levels, consecutive_levels or a plain comparison), threshold."""
    judged = _judged_levels(levels, criteria, reference)
    down = Window.partitionBy("criterion_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    runs = judged.withColumn("unbroken", F.bool_and("passes").over(down)).groupBy("criterion_id").agg(
        F.count_if("passes").alias("passing"), F.count(F.lit(1)).alias("levels"), F.count_if("unbroken").alias("consecutive"))
    joined = criteria.join(runs, "criterion_id", "left")
    every = F.col("passing") == F.col("levels")
    plain = ["lte", "gte", "lt", "gt", "absolute_lte"]
    status = (
        F.when(F.col("levels").isNull(), "NOT_APPLICABLE")
        .when(F.col("operator") == "consecutive_levels", F.when(F.col("consecutive") >= 2, "PASS").otherwise("FAIL"))
        .when(F.col("operator").isin("all_levels", *plain), F.when(every, "PASS").otherwise("FAIL"))
        .otherwise("NOT_APPLICABLE"))
    return joined.select("criterion_id", "metric", "operator", "threshold", F.coalesce("passing", F.lit(0)).alias("passing_levels"), status.alias("status"))


def _judged_levels(levels: DataFrame, criteria: DataFrame, reference: float) -> DataFrame:
    long = levels.where(F.col("level") != reference).unpivot(["level"], list(LEVEL_CRITERIA), "metric", "observed")
    rules = F.create_map(*[F.lit(x) for m, (e, _) in LEVEL_CRITERIA.items() for x in (m, e)])
    usable = criteria.where(rules[F.col("metric")] == F.col("endpoint"))
    upper = [m for m, (_, d) in LEVEL_CRITERIA.items() if d == "gte"]
    passes = F.when(F.col("metric").isin(upper), F.col("observed") >= F.col("threshold")).otherwise(F.col("observed") <= F.col("threshold"))
    return long.join(usable, "metric").withColumn("passes", passes)


def candidate_level(levels: DataFrame, criteria: DataFrame, reference: float) -> DataFrame:
    """Lowest level that every applicable criterion reaches from above without a gap."""
    per = _judged_levels(levels, criteria, reference).groupBy("level").agg(F.bool_and("passes").alias("common"))
    down = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("unbroken", F.bool_and("common").over(down)).agg(F.min(F.when(F.col("unbroken"), F.col("level"))).alias("candidate_level"))


def robustness_metrics(pairs: DataFrame, margin: float) -> DataFrame:
    half, mean = half_width("difference"), F.avg("difference")
    return pairs.agg(
        F.count(F.lit(1)).alias("pair_count"), mean.alias("mean_challenge_effect"), F.stddev_samp("difference").alias("challenge_effect_sd"),
        (mean - half).alias("lower"), (mean + half).alias("upper"), ((mean - half > -margin) & (mean + half < margin)).alias("effect_within_margin"),
        F.avg((~F.col("call_agreement")).cast("double")).alias("call_change_rate"), F.avg(F.col("qc_failure").cast("double")).alias("qc_failure_rate"))


def robustness_by_type(pairs: DataFrame, challenge: str = "challenge_type") -> DataFrame:
    return pairs.groupBy(challenge).agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg("difference").alias("mean_challenge_effect"),
        F.avg((~F.col("call_agreement")).cast("double")).alias("call_change_rate"), F.avg(F.col("qc_failure").cast("double")).alias("qc_failure_rate"))


# The endpoint each metric of a study is defined on.
METRIC_ENDPOINTS = {
    "precision": {"icc": "classifier_score", "categorical_agreement": "predicted_class", "repeatability_sd": "classifier_score", "reproducibility_sd": "classifier_score"},
    "bridging": {"paired_bias": "classifier_score", "categorical_agreement": "predicted_class", "discordance_rate": "predicted_class", "tost_equivalence": "classifier_score"},
    "robustness": {"mean_challenge_effect": "classifier_score", "call_change_rate": "predicted_class", "qc_failure_rate": "qc_failure"},
}


def study_metrics(wide: DataFrame) -> DataFrame:
    """(metric, observed) from one row of study metrics; an equivalence rule counts as 1 or 0."""
    if "equivalent" in wide.columns:
        wide = wide.withColumn("tost_equivalence", F.col("equivalent").cast("double"))
    names = [m for kind in METRIC_ENDPOINTS.values() for m in kind]
    held = [c for c in dict.fromkeys([*names, "profile_correlation"]) if c in wide.columns]
    return wide.select(*[F.col(c).cast("double").alias(c) for c in held]).unpivot([], held, "metric", "observed")


def criterion_status(observed: Column, operator: Column, low: Column, high: Column) -> Column:
    """PASS, FAIL, INDETERMINATE without an observation, NOT_APPLICABLE for an unknown operator."""
    passed = (
        F.when(operator == "gt", observed > low).when(operator == "gte", observed >= low).when(operator == "lt", observed < low)
        .when(operator == "lte", observed <= low).when(operator == "absolute_lte", F.abs(observed) <= low)
        .when(operator == "between", F.coalesce((observed >= low) & (observed <= high), F.lit(False))))
    absent = observed.isNull() | F.isnan(observed) | (F.abs(observed) == float("inf"))
    return (F.when(absent, "INDETERMINATE").when(passed.isNull(), "NOT_APPLICABLE").when(passed, "PASS").otherwise("FAIL"))


def evaluate_criteria(metrics: DataFrame, criteria: DataFrame, study: str) -> DataFrame:
    """metrics: (metric, observed) of a precision, bridging or robustness study. criteria: (criterion_id, metric,
    endpoint, operator, threshold array of one or two numbers). A metric that the study does not define on the endpoint
    is not applicable, and so is a correlation, which is descriptive. Only the precision study knows `between`, and only
    there an applicable metric without a value is indeterminate; elsewhere it is not applicable."""
    endpoints = F.create_map(*[F.lit(x) for kv in METRIC_ENDPOINTS[study].items() for x in kv])
    joined = criteria.join(metrics, "metric", "left")
    known = F.coalesce(endpoints[F.col("metric")] == F.col("endpoint"), F.lit(False))
    if study != "precision":
        known = known & F.col("observed").isNotNull() & (F.col("operator") != "between")
    status = F.when(~known, "NOT_APPLICABLE").otherwise(
        criterion_status(F.col("observed"), F.col("operator"), F.get("threshold", F.lit(0)), F.get("threshold", F.lit(1))))
    return joined.select("criterion_id", "metric", "operator", "observed", status.alias("status"))


def overall_status(results: DataFrame) -> DataFrame:
    state = (F.when(F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False)), "FAIL")
             .when(F.coalesce(F.bool_or(F.col("status").isin("INDETERMINATE", "NOT_APPLICABLE")), F.lit(False)), "INDETERMINATE").otherwise("PASS"))
    return results.agg(F.count(F.lit(1)).alias("criteria"), state.alias("overall_status"))

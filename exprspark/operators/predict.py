"""Locked prediction and external evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import one_row, spread_join
from exprspark.operators.metrics import binary_metrics, bootstrap_stratified, calibration_line


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-709.0)), F.lit(709.0))))


def model_digests(coefficients: DataFrame, model: DataFrame) -> DataFrame:
    """Order-free digests of the feature list, the scaling and the coefficients (sums of row hashes),
    and of the decision rule."""
    def rows_digest(*columns: str) -> Column:
        text = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
        part = F.conv(F.substring(text, 1, 14), 16, 10).cast("decimal(38,0)")
        return F.sha2(F.concat_ws("|", F.sum(part).cast("string"), F.count(F.lit(1)).cast("string")), 256)

    distinct = coefficients.select("feature_id", "mean", "scale").distinct()
    features = distinct.agg(rows_digest("feature_id").alias("feature_sha256"), rows_digest("feature_id", "mean", "scale").alias("preprocessing_sha256"))
    weights = coefficients.agg(rows_digest("feature_id", "class", "coefficient").alias("coefficient_sha256"))
    rule = model.select(F.sha2(F.concat_ws("|", F.array_join("classes", ","), F.col("threshold").cast("string"), F.col("calibration")), 256).alias("rule_sha256"))
    return one_row(one_row(features, weights), rule)


DIGESTS = ["feature_sha256", "preprocessing_sha256", "coefficient_sha256", "rule_sha256"]


def check_model(coefficients: DataFrame, model: DataFrame) -> None:
    """Dimensions, scales and digests, before anything is scored."""
    first = model.first()
    shape = coefficients.groupBy("feature_id").agg(F.count_distinct("class").alias("k"), F.count(F.lit(1)).alias("n"), F.min("scale").alias("s")).agg(
        F.count(F.lit(1)).alias("features"), F.min("k").alias("low"), F.max("n").alias("high"), F.min("s").alias("scale")).first()
    wanted = 1 if first["class_count"] == 2 else first["class_count"]
    if not shape["features"] or shape["low"] != wanted or shape["high"] != wanted or len(first["intercepts"]) != wanted:
        raise ValueError("Model features, classes and coefficients do not agree.")
    if shape["scale"] is None or not shape["scale"] > 0:
        raise ValueError("Model scales must be positive.")
    if set(DIGESTS) <= set(model.columns):
        seen = model_digests(coefficients, model).first()
        broken = [d for d in DIGESTS if seen[d] != first[d]]
        if broken:
            raise ValueError(f"Model integrity check failed: {', '.join(broken)}.")


def feature_overlap(coefficients: DataFrame, cells: DataFrame) -> DataFrame:
    seen = cells.select("feature_id").distinct().withColumn("_seen", F.lit(1))
    needed = coefficients.select("feature_id").distinct().join(seen, "feature_id", "left")
    return needed.agg(F.count(F.lit(1)).alias("required_feature_count"), F.count("_seen").alias("matched_feature_count"),
                      (F.count(F.lit(1)) - F.count("_seen")).alias("missing_feature_count"), (F.count("_seen") / F.count(F.lit(1))).alias("overlap_fraction"))


def decisions(cells: DataFrame, coefficients: DataFrame, intercepts: dict[str, float]) -> DataFrame:
    """(sample_id, class, decision). Absent cells are zeros, whose share -mean/scale*coefficient is
    one number per class, so only present cells are joined."""
    side = coefficients.select("feature_id", "class", (F.col("coefficient") / F.col("scale")).alias("_w"))
    base = coefficients.groupBy("class").agg(F.sum(F.col("mean") / F.col("scale") * F.col("coefficient")).alias("_b"))
    start = F.create_map(*[F.lit(x) for kv in intercepts.items() for x in kv])
    sums = spread_join(cells, side, ["feature_id"], "sample_id").groupBy("sample_id", "class").agg(F.sum(F.col("value") * F.col("_w")).alias("_s"))
    grid = cells.select("sample_id").distinct().crossJoin(F.broadcast(base))  # a few classes
    return grid.join(sums, ["sample_id", "class"], "left").select(
        "sample_id", "class", (F.coalesce("_s", F.lit(0.0)) - F.col("_b") + start[F.col("class")]).alias("decision"))


def predict_locked(cells: DataFrame, coefficients: DataFrame, model: DataFrame) -> DataFrame:
    """Binary: (sample_id, positive_probability, predicted_positive, predicted_class). Several
    classes: one row per (sample_id, class) with its probability and the predicted class. A missing
    model feature blocks the prediction."""
    check_model(coefficients, model)
    missing = coefficients.select("feature_id").distinct().join(cells, "feature_id", "left_anti")
    first_missing = missing.first()
    if first_missing is not None:
        raise ValueError(f"Required model feature '{first_missing[0]}' is missing.")
    m = model.first()
    classes = m["classes"]
    if m["class_count"] == 2:
        raw = decisions(cells, coefficients, {classes[1]: m["intercepts"][0]})
        d = F.col("decision")
        if m["calibration"] == "sigmoid":
            d = d * F.lit(m["calibration_slope"]) + F.lit(m["calibration_intercept"])
        elif m["calibration"] != "none":
            raise ValueError("The model uses an unsupported calibration.")
        scored = raw.select("sample_id", sigmoid(d).alias("positive_probability"))
        positive = F.col("positive_probability") >= m["threshold"]
        return scored.withColumn("predicted_positive", positive).withColumn("predicted_class", F.when(positive, classes[1]).otherwise(classes[0]))
    raw = decisions(cells, coefficients, dict(zip(classes, m["intercepts"])))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    per = raw.groupBy("sample_id").agg(F.max("decision").alias("_m"), F.min_by("class", F.struct(-F.col("decision"), order[F.col("class")])).alias("predicted_class"))
    shifted = raw.join(per, "sample_id").withColumn("_e", F.exp(F.col("decision") - F.col("_m")))
    totals = shifted.groupBy("sample_id").agg(F.sum("_e").alias("_t"))
    return shifted.join(totals, "sample_id").select("sample_id", "class", (F.col("_e") / F.col("_t")).alias("probability"), "predicted_class")


def truth_mismatch(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows that break the one-to-one match of predictions and truth: (code, sample_id)."""
    p, t = predictions.groupBy("sample_id").agg(F.count(F.lit(1)).alias("np")), truth.groupBy("sample_id").agg(F.count(F.lit(1)).alias("nt"))
    code = (F.when(F.col("np").isNull(), "NOT_PREDICTED").when(F.col("nt").isNull(), "NO_TRUTH").when((F.col("np") > 1) | (F.col("nt") > 1), "DUPLICATE"))
    return p.join(t, "sample_id", "full_outer").select(code.alias("code"), "sample_id").where("code is not null")


def evaluate_external(predictions: DataFrame, truth: DataFrame, negative: str, positive: str, threshold: float, minimum: float, minimum_lower: float,
                      replicates: int = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(metrics with calibration and verdict, bootstrap intervals). The published classes are
    derived again from the probabilities before anything is counted."""
    bad = truth_mismatch(predictions, truth).first()
    if bad is not None:
        raise ValueError(f"Predictions and truth do not match: {bad['code']} at '{bad['sample_id']}'.")
    p = F.col("positive_probability")
    derived = p >= threshold
    wrong = predictions.where(~p.between(0, 1) | (derived != F.col("predicted_positive")) | (F.when(derived, positive).otherwise(negative) != F.col("predicted_class")))
    if not wrong.isEmpty():
        raise ValueError("Published classes disagree with the locked threshold.")
    rows = predictions.join(truth, "sample_id").select("sample_id", (F.col("response") == positive).cast("int").alias("y"), p.alias("p"), F.col("predicted_positive").alias("predicted"))
    intervals = bootstrap_stratified(rows, replicates, seed)
    intercept, slope = calibration_line(rows, clip=1e-8, ridge=0.0)
    lower = intervals.where("metric = 'roc_auc'").select(F.col("lower").alias("roc_auc_lower"))
    out = one_row(binary_metrics(rows), lower).withColumn("calibration_intercept", F.lit(intercept)).withColumn("calibration_slope", F.lit(slope))
    point, bound = F.col("roc_auc") >= minimum, F.col("roc_auc_lower") > minimum_lower
    return out.withColumn("point_estimate_passed", point).withColumn("lower_bound_passed", bound).withColumn(
        "status", F.when(point & bound, "SUCCESS_CRITERIA_MET").otherwise("SUCCESS_CRITERIA_NOT_MET")), intervals

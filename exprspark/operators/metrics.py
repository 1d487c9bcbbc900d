"""Classifier metrics, curves and bootstrap intervals from counted scores.

Predictions are (y 0/1, p, predicted boolean). Everything that depends on the order of scores is
computed on one row per distinct score, so tied scores count as one threshold and cost one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.draws import draw, draw_wide
from exprspark.functions.ordering import one_row, row_numbers, running
from exprspark.session import cut


def _weight(df: DataFrame) -> Column:
    return F.col("weight") if "weight" in df.columns else F.lit(1)


def score_counts(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at every distinct score."""
    w = _weight(pred)
    return pred.groupBy(*by, "p").agg(
        F.sum(F.when(F.col("y") == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(w)).cast("bigint").alias("neg"))


def _totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))


def _with_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = _totals(counts, by)
    return counts.join(totals, list(by)) if by else one_row(counts, totals)


def ranking_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC area by rank sums and average precision, in one ordered pass. Where a class is absent, both are null."""
    placed = _with_totals(running(counts, by, ["p"], ["pos", "neg"]), by)
    above_pos = F.col("all_pos") - F.col("pos_before")
    above = F.col("all_pos") + F.col("all_neg") - F.col("pos_before") - F.col("neg_before")
    return placed.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), F.max("all_pos") * F.max("all_neg")).alias("roc_auc"),
        F.sum(F.try_divide(F.try_divide("pos", "all_pos") * above_pos, above)).alias("pr_auc"))


def confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w, y, yes = _weight(pred), F.col("y") == 1, F.col("predicted")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, w).otherwise(0)).cast("bigint")

    return pred.groupBy(*by).agg(
        total(y & yes).alias("true_positive"), total(~y & yes).alias("false_positive"),
        total(~y & ~yes).alias("true_negative"), total(y & ~yes).alias("false_negative"),
        F.try_divide(F.sum(w * (F.col("p") - F.col("y")) ** 2), F.sum(w)).alias("brier_score"))


def binary_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All threshold and ranking metrics of a binary classifier."""
    ranks, cells = ranking_metrics(score_counts(pred, by), by), confusion(pred, by)
    both = cells.join(ranks, list(by)) if by else one_row(cells, ranks)
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    one = F.lit(1)
    sensitivity, specificity = tp / F.greatest(tp + fn, one), tn / F.greatest(tn + fp, one)
    product = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return both.select(
        *by, "roc_auc", "pr_auc", ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
        ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), sensitivity.alias("sensitivity"), specificity.alias("specificity"),
        (tp / F.greatest(tp + fp, one)).alias("precision"), (2 * tp / F.greatest(2 * tp + fp + fn, one)).alias("f1"),
        F.when(product > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(product)).otherwise(0.0).alias("mcc"),
        "brier_score", "true_positive", "false_positive", "true_negative", "false_negative",
        ((tp + fn) / (tp + fp + tn + fn)).alias("prevalence"))


def youden(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of largest sensitivity + specificity; ties nearest 0.5, then the larger one. The
    thresholds 0, 0.5 and 1 always take part."""
    counts = score_counts(pred, by)
    fixed = _totals(counts, by).select(*by, F.explode(F.array(*[F.lit(t) for t in (0.0, 0.5, 1.0)])).alias("p"),
                                       F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    whole = counts.unionByName(fixed).groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    placed = _with_totals(running(whole, by, ["p"], ["pos", "neg"]), by)
    one = F.lit(1)
    j = (F.col("all_pos") - F.col("pos_before")) / F.greatest("all_pos", one) + F.col("neg_before") / F.greatest("all_neg", one) - 1
    best = F.max_by(F.struct(F.col("p").alias("threshold"), j.alias("youden")), F.struct(F.round(j, 12), -F.abs(F.col("p") - 0.5), F.col("p")))
    return placed.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def roc_points(pred: DataFrame) -> DataFrame:
    """ROC curve from the origin, without the inner points of straight pieces."""
    counts = score_counts(pred)
    placed = _with_totals(running(counts, [], ["p"], ["pos", "neg"]), [])
    numbered = row_numbers(placed.withColumn("_order", -F.col("p")), [], ["_order"], "rn").drop("_order")
    following = numbered.select((F.col("rn") - 1).alias("rn"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    bend = F.col("next_pos").isNull() | (F.col("rn") == 1) | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = numbered.join(following, "rn", "left").where(bend).select(
        F.try_divide(F.col("all_neg") - F.col("neg_before"), "all_neg").alias("false_positive_rate"),
        F.try_divide(F.col("all_pos") - F.col("pos_before"), "all_pos").alias("true_positive_rate"), F.col("p").alias("threshold"))
    origin = _totals(counts, []).select(F.lit(0.0).alias("false_positive_rate"), F.lit(0.0).alias("true_positive_rate"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(origin)


def precision_recall_points(pred: DataFrame) -> DataFrame:
    counts = score_counts(pred)
    placed = _with_totals(running(counts, [], ["p"], ["pos", "neg"]), [])
    above = F.col("all_pos") - F.col("pos_before")
    points = placed.select(
        F.try_divide(above, "all_pos").alias("recall"), F.try_divide(above, above + F.col("all_neg") - F.col("neg_before")).alias("precision"), F.col("p").alias("threshold"))
    end = _totals(counts, []).select(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def calibration_bins(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and observed share per probability bin; the last bin includes 1."""
    edges = [float(e) for e in np.linspace(0, 1, bins + 1)]
    reached = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("p")))
    return pred.groupBy(F.least(reached, F.lit(bins)).alias("bin")).agg(
        F.avg("p").alias("predicted_probability"), F.avg(F.col("y").cast("double")).alias("observed_fraction"), F.count(F.lit(1)).alias("sample_count"))


def logistic_lines(points: DataFrame, by: str, ridge: float = 1e-6, rounds: int = 60) -> dict[int, tuple[float, float]]:
    """`logistic_line` of every group of counted points (by, x, pos, n): the groups' Newton steps share their passes. `by` is an integer."""
    counts = cut(points)
    lines = {r[0]: np.zeros(2) for r in counts.select(by).distinct().collect()}  # one per fold
    left = sorted(lines)
    for _ in range(rounds):
        a, b = (F.create_map(*[F.lit(x) for g in left for x in (g, float(lines[g][i]))])[F.col(by)] for i in (0, 1))
        linear = F.least(F.greatest(a + b * F.col("x"), F.lit(-36.0)), F.lit(36.0))
        q = 1 / (1 + F.exp(-linear))
        gap, w, x = F.col("pos") - F.col("n") * q, F.col("n") * q * (1 - q), F.col("x")
        sums = counts.where(F.col(by).isin(left)).groupBy(by).agg(F.sum(gap), F.sum(gap * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).collect()
        left = []
        for g, g0, g1, h00, h01, h11 in sums:
            step = np.linalg.solve(np.array([[h00 + 1e-12, h01], [h01, h11 + ridge]]), np.array([g0, g1 - ridge * lines[g][1]]))
            step = step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            lines[g] = lines[g] + step
            if np.abs(step).max() >= 1e-10:
                left.append(g)
        if not left:
            break
    return {g: (float(v[0]), float(v[1])) for g, v in lines.items()}


def logistic_line(points: DataFrame, ridge: float = 1e-6, rounds: int = 60) -> tuple[float, float]:
    """(intercept, slope) of a logistic fit on counted points (x, pos, n). Newton steps on sums; two
    numbers of gradient and three of curvature reach the driver per step."""
    counts = cut(points.groupBy("x").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    a, b = 0.0, 0.0
    for _ in range(rounds):
        linear = F.least(F.greatest(F.lit(a) + F.lit(b) * F.col("x"), F.lit(-36.0)), F.lit(36.0))
        q = 1 / (1 + F.exp(-linear))
        gap, w, x = F.col("pos") - F.col("n") * q, F.col("n") * q * (1 - q), F.col("x")
        g0, g1, h00, h01, h11 = counts.agg(F.sum(gap), F.sum(gap * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
        step = np.linalg.solve(np.array([[h00 + 1e-12, h01], [h01, h11 + ridge]]), np.array([g0, g1 - ridge * b]))
        step = step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return a, b


def calibration_line(pred: DataFrame, clip: float = 1e-6, ridge: float = 1e-6) -> tuple[float, float]:
    """(intercept, slope) of a logistic fit of y on the log odds of p."""
    p = F.least(F.greatest("p", F.lit(clip)), F.lit(1 - clip))
    counts = score_counts(pred).select(F.log(p / (1 - p)).alias("x"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    return logistic_line(counts, ridge)


# ---- several classes: long rows (sample_id, observed, class, probability)


def predicted_classes(long: DataFrame, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Most probable class per sample, ties to the first label."""
    return long.groupBy(*key).agg(
        F.min("observed").alias("observed"), F.min_by("class", F.struct(-F.col("probability"), F.col("class"))).alias("predicted"))


def class_confusion(long: DataFrame, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    return predicted_classes(long, key).groupBy("observed", "predicted").agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro one-versus-rest ROC area, macro F1, balanced accuracy, accuracy and log loss. `weight`,
    if present, is the multiplicity of the row's sample in its replicate."""
    by = list(by)
    has_weight = "weight" in long.columns
    w = F.col("weight") if has_weight else F.lit(1)
    one_vs_rest = long.select(*by, "class", (F.col("observed") == F.col("class")).cast("int").alias("y"), F.col("probability").alias("p"),
                              *([F.col("weight")] if has_weight else []))
    areas = ranking_metrics(score_counts(one_vs_rest, [*by, "class"]), [*by, "class"])
    macro_auc = areas.groupBy(*by).agg(F.avg("roc_auc").alias("macro_roc_auc"))
    per_sample = long.groupBy(*by, "sample_id").agg(
        F.min("observed").alias("observed"), F.min_by("class", F.struct(-F.col("probability"), F.col("class"))).alias("predicted"),
        F.max(F.when(F.col("class") == F.col("observed"), F.col("probability"))).alias("q"), F.min(w).alias("w"))
    cells = per_sample.groupBy(*by, "observed", "predicted").agg(F.sum("w").alias("n"))
    hit = F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(*by, F.col("observed").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("called"), hit.alias("hit")).unionByName(
        cells.select(*by, F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")))
    per_class = sides.groupBy(*by, "class").agg(F.sum("actual").alias("actual"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    rates = per_class.groupBy(*by).agg(
        F.avg(2 * F.col("hit") / (F.col("actual") + F.col("called"))).alias("macro_f1"),
        F.avg(F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))).alias("balanced_accuracy"),
        (F.sum("hit") / F.sum("actual")).alias("accuracy"))
    tiny = float(np.finfo(float).eps)
    loss = per_sample.groupBy(*by).agg(
        (-F.sum(F.col("w") * F.log(F.least(F.greatest("q", F.lit(tiny)), F.lit(1 - tiny)))) / F.sum("w")).alias("log_loss"))
    if by:
        return macro_auc.join(rates, by).join(loss, by)
    return one_row(one_row(macro_auc, rates), loss)


# ---- bootstrap

BINARY_NAMES = ["roc_auc", "pr_auc", "balanced_accuracy", "brier_score"]
MULTICLASS_NAMES = ["macro_roc_auc", "macro_f1", "balanced_accuracy", "accuracy", "log_loss"]


def group_index(df: DataFrame, group: str) -> DataFrame:
    """(group, slot 0..G-1) in an order drawn from the group's name."""
    groups = df.select(group).distinct().withColumn("_key", draw_wide(F.col(group)))
    return row_numbers(groups, [], ["_key", group], "_rn").select(group, (F.col("_rn") - 1).alias("slot"))


def group_draws(index: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, weight): how often each group is drawn when as many groups as exist are
    drawn with replacement."""
    size = index.agg(F.count(F.lit(1)).alias("_g"))
    slots = one_row(index.select("slot"), size).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = F.pmod(draw(seed, F.col("replicate"), F.col("slot")), F.col("_g"))
    counts = slots.groupBy("replicate", drawn.alias("slot")).agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(index, "slot").select("replicate", group, "weight")


def sample_means(pred: DataFrame) -> DataFrame:
    """One row per sample over its repeats: mean probability and majority call."""
    return pred.groupBy("sample_id").agg(
        F.coalesce(F.min("group"), F.first("sample_id")).alias("group"), F.min("y").alias("y"), F.avg("p").alias("p"),
        (F.avg(F.col("predicted").cast("double")) >= 0.5).alias("predicted"))


def _first_valid(draw_metrics, classes_needed: str, replicates: int, give_up: int) -> DataFrame:
    """Draw until `replicates` resamples hold every class, at most `give_up` times as many."""
    attempts = replicates
    while True:
        rows = cut(draw_metrics(attempts).where(classes_needed))
        if rows.count() >= replicates:
            return rows.orderBy("replicate").limit(replicates)
        if attempts >= replicates * give_up:
            raise ValueError("The bootstrap could not produce the requested valid resamples.")
        attempts = min(attempts * 2, replicates * give_up)


def _intervals(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    long = rows.unpivot(["replicate"], list(names), "metric", "value")
    return long.groupBy("metric").agg(F.percentile("value", 0.025).alias("lower"), F.percentile("value", 0.975).alias("upper"))


def bootstrap_ci(pred: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Percentile intervals over resampled experimental units. Samples of a unit are first counted
    per distinct score, so a resample joins histograms, not samples."""
    per_sample = sample_means(pred)
    index = cut(group_index(per_sample, "group"))
    histogram = cut(per_sample.groupBy("group", "p", "y", "predicted").agg(F.count(F.lit(1)).alias("k")))

    def metrics(attempts: int) -> DataFrame:
        drawn = group_draws(index, "group", attempts, seed)
        rows = histogram.join(drawn, "group").withColumn("weight", F.col("weight") * F.col("k"))
        return binary_metrics(rows, ["replicate"])

    valid = "true_positive + false_negative > 0 and true_negative + false_positive > 0"
    return _intervals(_first_valid(metrics, valid, replicates, 20), BINARY_NAMES)


def bootstrap_ci_multiclass(long: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """As `bootstrap_ci` for class probabilities, averaged over a sample's repeats first."""
    per = long.groupBy("sample_id", "class").agg(
        F.coalesce(F.min("group"), F.first("sample_id")).alias("group"), F.min("observed").alias("observed"), F.avg("probability").alias("probability"))
    per = cut(per)
    index = cut(group_index(per, "group"))
    classes = per.agg(F.count_distinct("class")).first()[0]

    def metrics(attempts: int) -> DataFrame:
        rows = per.join(group_draws(index, "group", attempts, seed), "group")
        seen = rows.groupBy("replicate").agg(F.count_distinct("observed").alias("observed_classes"))
        return multiclass_metrics(rows, ["replicate"]).join(seen, "replicate")

    return _intervals(_first_valid(metrics, f"observed_classes = {classes}", replicates, 30), MULTICLASS_NAMES)


def bootstrap_stratified(pred: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile intervals over samples redrawn within each class."""
    keyed = pred.withColumn("_key", draw_wide(F.col("sample_id")))
    rows = cut(row_numbers(keyed, ["y"], ["_key", "sample_id"], "_rn").select("y", "p", "predicted", (F.col("_rn") - 1).alias("slot")))
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))  # two rows
    slots = rows.select("y", "slot").join(F.broadcast(sizes), "y").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = F.pmod(draw(seed, F.col("y"), F.col("replicate"), F.col("slot")), F.col("_n"))
    weights = slots.groupBy("replicate", "y", drawn.alias("slot")).agg(F.count(F.lit(1)).alias("weight"))
    return _intervals(binary_metrics(rows.join(weights, ["y", "slot"]), ["replicate"]),
                      ["roc_auc", "pr_auc", "balanced_accuracy", "sensitivity", "specificity", "brier_score"])


# ---- scores compared between two groups


def directional_auc(scores: DataFrame, by: Sequence[str], numerator: str, direction: str = "positive") -> DataFrame:
    """Share of (numerator, other) pairs ordered as expected, ties counting half. `scores` has the
    columns level and score."""
    sign = F.lit(1.0 if direction == "positive" else -1.0)
    pred = scores.select(*by, (F.col("level") == numerator).cast("int").alias("y"), (sign * F.col("score")).alias("p"))
    return ranking_metrics(score_counts(pred, by), by).select(*by, F.col("roc_auc").alias("auc"))


def group_effect(scores: DataFrame, by: Sequence[str], numerator: str) -> DataFrame:
    """Mean difference numerator minus the rest, and the same in pooled standard deviations."""
    up = F.col("level") == numerator

    def of(condition: Column, function) -> Column:
        return function(F.when(condition, F.col("score")))

    n1, n0 = F.count_if(up), F.count_if(~up)
    effect = of(up, F.avg) - of(~up, F.avg)
    pooled = F.try_divide((n1 - 1) * of(up, F.var_samp) + (n0 - 1) * of(~up, F.var_samp), n1 + n0 - 2)
    return scores.groupBy(*by).agg(
        n1.alias("numerator_count"), n0.alias("denominator_count"), effect.alias("effect"), F.try_divide(effect, F.sqrt(pooled)).alias("standardized_effect"),
        F.min("score").alias("score_minimum"), F.max("score").alias("score_maximum"))


def benchmark_scores(scores: DataFrame, numerator: str, direction: str, minimum_auc: float, minimum_samples: int, preference: list[str]) -> DataFrame:
    """Per (method, set): effect, directional AUC and pass; per method whether all sets pass, and the
    first passing method of the preference order. `scores`: method, set_id, level, score."""
    by = ["method", "set_id"]
    both = group_effect(scores, by, numerator).join(directional_auc(scores, by, numerator, direction), by)
    right_way = F.col("effect") > 0 if direction == "positive" else F.col("effect") < 0
    enough = F.least("numerator_count", "denominator_count") >= minimum_samples
    judged = both.withColumn("passed", right_way & enough & (F.col("auc") >= minimum_auc))
    methods = judged.groupBy("method").agg(F.bool_and("passed").alias("method_passed"))
    order = F.array_position(F.array(*[F.lit(m) for m in preference]), F.col("method"))
    chosen = methods.where("method_passed").agg(F.min_by("method", order).alias("selected_method"))
    return one_row(judged.join(methods, "method"), chosen).select(
        "method", "set_id", "effect", "auc", "passed", "method_passed", "selected_method")


def cohort_concordance(scores: DataFrame, numerator: str, minimum_auc: float) -> tuple[DataFrame, DataFrame]:
    """(per cohort effect, AUC, direction and pass; one row of concordance over cohorts).
    `scores`: cohort, level, score."""
    per = group_effect(scores, ["cohort"], numerator).join(directional_auc(scores, ["cohort"], numerator), "cohort")
    direction = F.when(F.col("effect") > 0, "positive").when(F.col("effect") < 0, "negative").otherwise("zero")
    per = per.select("cohort", "effect", "standardized_effect", "auc", "score_minimum", "score_maximum", direction.alias("direction")).withColumn(
        "passed", (F.col("auc") >= minimum_auc) & (F.col("direction") == "positive"))
    width = F.col("score_maximum") - F.col("score_minimum")
    verdict = per.agg(
        F.bool_and(F.col("direction") == "positive").alias("direction_concordant"), F.bool_and(F.col("auc") >= minimum_auc).alias("all_meet_auc"),
        (F.try_divide(F.max(width), F.min(width)) >= 2.0).alias("raw_scales_distinct"), F.bool_and("passed").alias("all_passed"))
    return per, verdict.withColumn("passed", F.col("all_passed") & F.col("raw_scales_distinct"))

"""Assay experiments: assignment and design checks, paired and ordered-level comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprspark.functions.ordering import medians, one_row, spread_join
from exprspark.functions.text import blank, numeric, parse_flag
from exprspark.operators.design import Design, design_rank
from exprspark.operators.validate import finding, union_all

Z95 = 1.96  # fixed value: normal quantile of the published intervals


def _when(df: DataFrame, condition: Column, code: str, severity: str = "ERROR") -> DataFrame:
    """One finding if the one-row frame satisfies the condition."""
    return finding(df.where(condition), code, severity=severity)


def included(assignments: DataFrame) -> DataFrame:
    return assignments.where(F.coalesce(parse_flag(F.col("include").cast("string")), F.lit(False)))


def check_assignments(assignments: DataFrame, required: list[str]) -> DataFrame:
    """Repeated ids, unreadable include flags, exclusions without a reason, blank required fields."""
    flag = parse_flag(F.col("include").cast("string"))
    identity = F.col("measurement_id")
    out = assignments.where(~F.coalesce(flag, F.lit(False)))
    empty = reduce(lambda a, b: a | b, [blank(F.col(c).cast("string")) for c in required])
    return union_all([
        finding(assignments.groupBy("measurement_id").count().where("count > 1"), "ASSIGNMENT.DUPLICATE_MEASUREMENT", identity),
        finding(assignments.where(flag.isNull()), "ASSIGNMENT.INVALID_INCLUDE", identity),
        finding(out.where(blank(F.col("exclusion_reason"))), "ASSIGNMENT.EXCLUSION_REASON_REQUIRED", identity),
        finding(included(assignments).where(empty), "ASSIGNMENT.METADATA_REQUIRED", identity),
    ])


def check_pairs(rows: DataFrame, reference: str, comparator: str, minimum: int) -> DataFrame:
    """Every sample needs exactly one reference and one comparator, and there must be enough."""
    per = rows.where(~blank(F.col("biological_sample_id")) & ~blank(F.col("condition"))).groupBy("biological_sample_id").agg(
        F.count_if(F.col("condition") == reference).alias("r"), F.count_if(F.col("condition") == comparator).alias("c"))
    whole = (F.col("r") == 1) & (F.col("c") == 1)
    totals = per.agg(F.count_if(whole).alias("pairs"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    return union_all([
        finding(per.where(~whole), "DESIGN.PAIRED_CONDITIONS_INCOMPLETE", F.col("biological_sample_id")),
        _when(totals, F.col("pairs") < minimum, "DESIGN.INSUFFICIENT_COMPLETE_PAIRS"),
        _when(totals, F.col("r") == 0, "DESIGN.REFERENCE_CONDITION_MISSING"),
        _when(totals, F.col("c") == 0, "DESIGN.COMPARATOR_CONDITION_MISSING"),
    ])


def check_confounding(rows: DataFrame, condition: str, factor: str) -> DataFrame:
    """One row: is the factor perfectly aligned with the condition, or seen at one level only for
    some condition."""
    cells = rows.where(~blank(F.col(condition).cast("string")) & ~blank(F.col(factor).cast("string"))).select(condition, factor).distinct()
    per_condition = cells.groupBy(condition).agg(F.count(F.lit(1)).alias("k"))
    per_level = cells.groupBy(factor).agg(F.count(F.lit(1)).alias("k"))
    a = per_condition.agg(F.count(F.lit(1)).alias("conditions"), F.coalesce(F.bool_and(F.col("k") == 1), F.lit(True)).alias("one_level"),
                          F.coalesce(F.bool_or(F.col("k") == 1), F.lit(False)).alias("some_one_level"))
    b = per_level.agg(F.count(F.lit(1)).alias("levels"), F.coalesce(F.bool_and(F.col("k") == 1), F.lit(True)).alias("one_condition"))
    confounded = (F.col("conditions") > 1) & F.col("one_level") & F.col("one_condition")
    return one_row(a, b).select(
        F.lit(factor).alias("factor"), "conditions", "levels", confounded.alias("confounded"),
        (~confounded & F.col("some_one_level") & (F.col("levels") > 1)).alias("imbalanced"))


def check_levels(rows: DataFrame, reference: float, exact: bool = False) -> DataFrame:
    """Ordered levels: the reference occurs, at least three levels, every sample has the reference
    and another level (with `exact`, exactly one measurement at each level)."""
    usable = rows.where(F.col("level").isNotNull())
    bad = finding(rows.where(F.col("level").isNull() | (F.col("level") <= 0)), "ASSIGNMENT.INVALID_LEVEL", F.col("measurement_id"))
    levels = usable.select("level").distinct().agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("level") == reference).alias("r"))
    per = usable.groupBy("biological_sample_id").agg(
        F.count_distinct("level").alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == reference).alias("r"))
    sample = F.col("biological_sample_id")
    parts = [
        bad,
        _when(levels, F.col("r") == 0, "DESIGN.REFERENCE_LEVEL_MISSING"),
        _when(levels, F.col("k") < 3, "DESIGN.ORDERED_LEVELS_LIMITED", "ERROR" if exact else "WARNING"),
    ]
    if exact:
        wide = one_row(per, levels.select("k"))
        parts += [
            finding(wide.where((F.col("d") != F.col("k")) | (F.col("n") != F.col("k"))), "STUDY.PAIRED_LEVELS_INCOMPLETE", sample),
            _when(per.agg(F.count(F.lit(1)).alias("s")), F.col("s") < 3, "STUDY.BIOLOGICAL_SAMPLES_INSUFFICIENT"),
        ]
    else:
        parts += [
            finding(per.where("r = 0"), "DESIGN.PAIRED_REFERENCE_MISSING", sample),
            finding(per.where("d < 2"), "DESIGN.PAIRED_CHALLENGE_MISSING", sample),
        ]
    return union_all(parts)


def check_precision(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Repeats per sample, levels per factor, and whether the factors are separable."""
    per = rows.groupBy("biological_sample_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per.agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    levels = rows.agg(*[F.count_distinct(f).alias(f) for f in factors])
    parts = [
        finding(rows.groupBy("measurement_id").count().where("count > 1"), "STUDY.MEASUREMENT_NOT_UNIQUE", F.col("measurement_id")),
        _when(totals, F.col("samples") < 2, "STUDY.BIOLOGICAL_SAMPLES_INSUFFICIENT"),
        finding(per.where("n < 2"), "STUDY.REPEATS_INSUFFICIENT", F.col("biological_sample_id")),
        _when(totals, F.col("n") < 12, "STUDY.SMALL_PRECISION_DESIGN", "WARNING"),
    ]
    parts += [_when(levels, F.col(f) < 2, "STUDY.FACTOR_LEVELS_INSUFFICIENT") for f in factors]
    meta = rows.withColumnRenamed("measurement_id", "sample_id")
    rank, columns = design_rank(meta, Design(terms=list(factors), categorical=list(factors)))
    parts.append(_when(totals, F.lit(rank < columns), "STUDY.FACTOR_CONFOUNDING"))
    return union_all(parts)


def measurement_endpoints(cells: DataFrame, assignments: DataFrame, features: int | None = None) -> DataFrame:
    """Detected features, mean and failure of every assigned measurement. Absent cells are zeros of
    the `features` rows of the matrix."""
    odd = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    per = cells.groupBy(F.col("sample_id").alias("measurement_id")).agg(
        F.count_if(~odd & (F.col("value") != 0)).alias("detected_genes"), F.sum("value").alias("_sum"), F.max(odd.cast("int")).alias("_odd"))
    count = F.lit(features) if features is not None else F.col("_features")
    if features is None:
        per = one_row(per, cells.agg(F.count_distinct("feature_id").alias("_features")))
    failed = F.col("_odd") == 1
    values = per.select("measurement_id", "detected_genes", F.when(~failed, F.col("_sum") / count).alias("mean_expression"), failed.alias("technical_failure"))
    return assignments.join(values, "measurement_id")


def profile_correlation(cells: DataFrame, pairs: DataFrame, features: int | None = None) -> DataFrame:
    """Correlation over features of each (left_id, right_id): 1 when the profiles are equal, 0 when
    either is constant. Each pair's cells meet feature by feature; sums are combined before the
    shuffle, so no profile is gathered anywhere. Absent cells are zeros."""
    n = F.lit(float(features)) if features is not None else F.lit(float(cells.select("feature_id").distinct().count()))

    def side(column: str) -> DataFrame:
        keyed = pairs.select("left_id", "right_id", F.col(column).alias("sample_id"))
        value = F.col("value")
        x, y = (value, F.lit(None).cast("double")) if column == "left_id" else (F.lit(None).cast("double"), value)
        return spread_join(cells, keyed, ["sample_id"], "feature_id").select("left_id", "right_id", "feature_id", x.alias("x"), y.alias("y"))

    both = side("left_id").unionByName(side("right_id")).groupBy("left_id", "right_id", "feature_id").agg(
        F.coalesce(F.max("x"), F.lit(0.0)).alias("x"), F.coalesce(F.max("y"), F.lit(0.0)).alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("left_id", "right_id").agg(
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.max((x != y).cast("int")).alias("differ"))
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    flat = (vx <= 1e-12 * n * F.col("sxx")) | (vy <= 1e-12 * n * F.col("syy"))
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    value = F.when(F.col("differ") == 0, 1.0).when(flat, 0.0).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return sums.select("left_id", "right_id", value.alias("correlation"))


def pair_sides(rows: DataFrame, reference: str, comparator: str, columns: list[str]) -> DataFrame:
    """One row per biological sample with reference_* and comparator_* columns: an aggregation, not
    a self-join."""
    picks = []
    for role, name in (("reference", reference), ("comparator", comparator)):
        picks += [F.max(F.when(F.col("condition") == name, F.col(c))).alias(f"{role}_{c}") for c in columns]
    wanted = rows.where(F.col("condition").isin(reference, comparator))
    return wanted.groupBy("biological_sample_id").agg(*picks).where(
        "reference_measurement_id is not null and comparator_measurement_id is not null")


def pair_table(endpoints: DataFrame, cells: DataFrame, reference: str, comparator: str, features: int | None = None) -> DataFrame:
    """Differences, averages, profile correlation, discordance and quality of every pair."""
    columns = ["measurement_id", "mean_expression", "detected_genes", "technical_failure", "quality_metric"]
    pairs = pair_sides(endpoints, reference, comparator, columns)
    keys = pairs.select(F.col("comparator_measurement_id").alias("left_id"), F.col("reference_measurement_id").alias("right_id"))
    matched = profile_correlation(cells, keys, features).select(
        F.col("left_id").alias("comparator_measurement_id"), F.col("right_id").alias("reference_measurement_id"), "correlation")
    c, ref = F.col("comparator_mean_expression"), F.col("reference_mean_expression")
    return pairs.join(matched, ["comparator_measurement_id", "reference_measurement_id"]).select(
        "biological_sample_id", "reference_measurement_id", "comparator_measurement_id",
        (c - ref).alias("difference"), ((c + ref) / 2).alias("average"),
        (F.col("comparator_detected_genes") - F.col("reference_detected_genes")).alias("detected_genes_difference"),
        "correlation", (1 - F.col("correlation")).alias("profile_discordance"),
        F.col("reference_technical_failure").alias("reference_failure"), F.col("comparator_technical_failure").alias("comparator_failure"),
        (F.col("reference_technical_failure") != F.col("comparator_technical_failure")).alias("call_discordant"),
        F.coalesce("comparator_quality_metric", "reference_quality_metric").alias("quality_metric"))


def half_width(value: str) -> Column:
    """1.96 standard errors of a mean; 0 for a single row."""
    return F.when(F.count(value) > 1, Z95 * F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(0.0)


def pair_summary(pairs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    failures = [F.count_if(F.col(f"{s}_failure")) for s in ("reference", "comparator")]
    whole = pairs.agg(
        n.alias("pair_count"), F.avg("difference").alias("mean_paired_difference"),
        (F.avg("difference") - half_width("difference")).alias("lower"), (F.avg("difference") + half_width("difference")).alias("upper"),
        F.avg("correlation").alias("mean_profile_correlation"), F.avg("profile_discordance").alias("mean_profile_discordance"),
        (failures[0] / n).alias("reference_failure_rate"), (failures[1] / n).alias("comparator_failure_rate"),
        ((failures[1] - failures[0]) / n).alias("failure_rate_difference"), F.count_if("call_discordant").alias("discordant_pair_count"))
    return one_row(whole, medians(pairs, [], "correlation", "median_profile_correlation"))


def quality_slope(pairs: DataFrame) -> DataFrame:
    """Slope of the paired difference on quality with its interval. Not estimable below three pairs
    or two quality values."""
    rows = pairs.where("quality_metric is not null and difference is not null").select(F.col("quality_metric").alias("x"), F.col("difference").alias("y"))
    per = rows.agg(
        F.count(F.lit(1)).alias("pair_count"), F.count_distinct("x").alias("values"), F.regr_slope("y", "x").alias("slope"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    usable = (F.col("pair_count") >= 3) & (F.col("values") >= 2)
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / (F.col("pair_count") - 2)
    half = Z95 * F.sqrt(residual / F.col("sxx"))
    return per.select(
        F.when(usable, "ESTIMATED").otherwise("NOT_ESTIMABLE").alias("status"), "pair_count", F.when(usable, F.col("slope")).alias("slope"),
        F.when(usable, F.col("slope") - half).alias("lower"), F.when(usable, F.col("slope") + half).alias("upper"))


def bland_altman(pairs: DataFrame, value: str = "difference") -> DataFrame:
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return pairs.agg(F.avg(value).alias("bias"), sd.alias("sd"), (F.avg(value) - Z95 * sd).alias("lower_limit"), (F.avg(value) + Z95 * sd).alias("upper_limit"))


def level_summary(rows: DataFrame, reference: float) -> DataFrame:
    """Per ordered level: correlation to the sample's own reference profile, with its interval."""
    mean, half = F.avg("correlation"), half_width("correlation")
    per = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("measurement_count"), mean.alias("mean_profile_correlation"),
        F.avg("detected_genes").alias("mean_detected_genes"), F.avg("mean_expression").alias("mean_expression"),
        F.greatest(F.lit(-1.0), mean - half).alias("lower"), F.least(F.lit(1.0), mean + half).alias("upper"))
    joined = per.join(medians(rows, ["level"], "correlation", "median_profile_correlation"), "level")
    return joined.withColumn("paired_reference", F.col("level") == reference).withColumn("stable", F.col("mean_profile_correlation") >= 0.95)


def lowest_level(summary: DataFrame, reference: float, passing: str = "stable") -> DataFrame:
    """Lowest level reached from above without a failing one. One row per ordered level."""
    down = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    run = summary.where(F.col("level") != reference).select("level", F.bool_and(passing).over(down).alias("unbroken"))
    return run.agg(F.min(F.when(F.col("unbroken"), F.col("level"))).alias("lowest_level"))


def factor_balance(rows: DataFrame, condition: str, factor: str) -> DataFrame:
    return rows.groupBy(condition, factor).agg(F.count(F.lit(1)).alias("measurement_count"))


def confounding_matrix(rows: DataFrame, condition: str, factor: str, levels: list[str] | None = None) -> DataFrame:
    return rows.groupBy(condition).pivot(factor, levels).count().na.fill(0)


def feasibility_summary(endpoints: DataFrame, factors: list[str], measures: list[str]) -> DataFrame:
    """Success rate and medians for every level of every factor and for all rows: each row is
    repeated once per grouping, then grouped once."""
    label = [F.struct(F.lit(f).alias("factor"), F.coalesce(F.when(~blank(F.col(f).cast("string")), F.col(f).cast("string")), F.lit("not_recorded")).alias("level")) for f in factors]
    whole = F.struct(F.lit("all").alias("factor"), F.lit("all").alias("level"))
    rows = endpoints.withColumn("_g", F.explode(F.array(*label, whole))).select("_g.*", "technical_failure", *[F.col(m).cast("double").alias(m) for m in measures])
    out = rows.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("measurement_count"), F.count_if(~F.col("technical_failure")).alias("successful_measurements"),
        F.avg((~F.col("technical_failure")).cast("double")).alias("technical_success_rate"))
    for m in measures:
        out = out.join(medians(rows, ["factor", "level"], m, f"median_{m}"), ["factor", "level"], "left")
    return out


NUMERIC_FIELDS = ["input_ng", "dv200", "quality_metric", "input_level"]


def typed_assignments(assignments: DataFrame) -> DataFrame:
    """Assignment text with its numeric fields as numbers (unreadable ones NULL)."""
    out = assignments
    for name in NUMERIC_FIELDS:
        if name in out.columns:
            out = out.withColumn(name, numeric(F.col(name).cast("string")))
    return out

"""Sample quality control and count normalisation over long cells; absent cells are zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import ROWS_PER_TASK, average_ranks, counted_join, medians, one_row, quantiles, spread_join, tie_quantiles
from exprspark.functions.text import rounded
from exprspark.operators.mapping import median_absolute_deviation
from exprspark.operators.matrix import pca, shape_of
from exprspark.session import cut


def feature_total(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("feature_id").alias("feature_count"))


def sample_qc(cells: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Library size, detected features and their fractions per sample. `features` is a one-row
    feature_count when the matrix has features that no cell shows."""
    per = cells.groupBy("sample_id").agg(
        F.sum("value").alias("library_size"), F.count_if(F.col("value") > 0).alias("detected_features"))
    share = F.col("detected_features") / F.col("feature_count")
    return one_row(per, features if features is not None else feature_total(cells)).select(
        "sample_id", rounded(F.col("library_size"), 8).alias("library_size"), "detected_features",
        rounded(share, 8).alias("detected_fraction"), rounded(1 - share, 8).alias("zero_fraction"))


def flag_samples(qc: DataFrame) -> DataFrame:
    """REVIEW when the library is below a fifth, or detection below half, of the cohort median."""
    qc = cut(qc)
    if qc.count() <= ROWS_PER_TASK:
        middle = qc.agg(F.percentile("library_size", 0.5).alias("median_library"), F.percentile("detected_features", 0.5).alias("median_detected"))
    else:
        middle = one_row(medians(qc, [], "library_size", "median_library"), medians(qc, [], "detected_features", "median_detected"))
    reasons = F.array_compact(F.array(
        F.when((F.col("median_library") > 0) & (F.col("library_size") < F.col("median_library") * 0.2), "LOW_LIBRARY_SIZE"),
        F.when((F.col("median_detected") > 0) & (F.col("detected_features") < F.col("median_detected") * 0.5), "LOW_DETECTED_FEATURES")))
    return one_row(qc, middle).select(
        *qc.columns, F.when(F.size(reasons) > 0, "REVIEW").otherwise("PASS").alias("status"), F.array_join(reasons, ";").alias("reasons"))


def log_cpm(cells: DataFrame) -> DataFrame:
    """log2 of counts per million plus one; an absent cell stays absent because its value is 0."""
    totals = cells.groupBy("sample_id").agg(F.sum("value").alias("_total"))
    scaled = F.when(F.col("_total") > 0, F.log2(F.col("value") / F.col("_total") * 1e6 + 1)).otherwise(0.0)
    return spread_join(cells, totals, ["sample_id"], "feature_id").select("feature_id", "sample_id", scaled.alias("value"))


def raw_qc(gene_counts: DataFrame, feat: DataFrame, stats: DataFrame) -> DataFrame:
    """Mapping rate, mitochondrial and ribosomal share per sample. Shares are NULL when the
    annotation names no chromosome or no gene type at all."""
    chromosome = F.upper(F.regexp_replace(F.coalesce("seqname", F.lit("")), "(?i)^CHR", ""))
    marked = feat.select(
        "feature_id", chromosome.isin("M", "MT").alias("_mito"),
        F.lower(F.coalesce("gene_type", F.lit(""))).rlike("(^|_)rrna($|_)").alias("_ribo"))
    known = feat.agg((F.count_if(F.coalesce("seqname", F.lit("")) != "") > 0).alias("_has_mito"),
                     (F.count_if(F.coalesce("gene_type", F.lit("")) != "") > 0).alias("_has_ribo"))
    whole = gene_counts.withColumn("value", F.bround("value"))
    per = spread_join(whole, marked, ["feature_id"], "sample_id", "left").groupBy("sample_id").agg(
        F.sum("value").alias("library_size"), F.count_if(F.col("value") > 0).alias("detected_genes"),
        F.sum(F.when(F.col("_mito"), F.col("value")).otherwise(0.0)).alias("_m"),
        F.sum(F.when(F.col("_ribo"), F.col("value")).otherwise(0.0)).alias("_r"))
    wide = one_row(one_row(per.join(stats, "sample_id"), known), feature_total(gene_counts))
    mito, ribo = F.when(F.col("_has_mito"), F.col("_m")), F.when(F.col("_has_ribo"), F.col("_r"))
    usable = F.col("library_size") > 0
    return wide.select(
        "sample_id", "library_size", "detected_genes",
        (100 * F.col("detected_genes") / F.col("feature_count")).alias("detected_genes_percent"),
        (100 * F.col("num_mapped") / F.greatest(F.col("num_processed"), F.lit(1))).alias("mapping_rate_percent"),
        mito.alias("mitochondrial_counts"), F.when(usable, 100 * mito / F.col("library_size")).alias("mitochondrial_percent"),
        ribo.alias("ribosomal_counts"), F.when(usable, 100 * ribo / F.col("library_size")).alias("ribosomal_percent"))


def mean_sample_corr(cells: DataFrame) -> DataFrame:
    """Mean Pearson correlation of log1p counts with every other sample. Constant samples have no correlation and are left
    out, as is a sample without another one. With samples scaled to mean 0 and length 1, the correlations of a sample
    add up to its product with the sum of all samples, so two passes over the cells do."""
    logged = cells.withColumn("value", F.log1p(F.bround("value")))
    features = F.lit(float(shape_of(cells)[0]))
    per = logged.groupBy("sample_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    varied = per.where(features * F.col("_q") - F.col("_s") ** 2 > 1e-12 * features * F.col("_q"))
    length = F.sqrt(F.col("_q") - F.col("_s") ** 2 / features)
    side = cut(varied.select("sample_id", (1 / length).alias("_a"), (F.col("_s") / features / length).alias("_b"), "_s"))
    scaled = spread_join(logged, side.select("sample_id", "_a"), ["sample_id"], "feature_id").select("sample_id", "feature_id", (F.col("value") * F.col("_a")).alias("z"))
    sums = cut(scaled.groupBy("feature_id").agg(F.sum("z").alias("_y")))
    dots = spread_join(scaled, sums, ["feature_id"], "sample_id").groupBy("sample_id").agg(F.sum(F.col("z") * F.col("_y")).alias("_dot"))
    whole = one_row(side.agg(F.sum("_b").alias("_all"), F.count(F.lit(1)).alias("_n")), sums.agg(F.sum("_y").alias("_ys")))
    total = F.col("_dot") - F.col("_a") * F.col("_all") * F.col("_s") - F.col("_b") * F.col("_ys") + features * F.col("_b") * F.col("_all")
    return one_row(dots.join(side, "sample_id"), whole).where("_n > 1").select("sample_id", ((total - 1) / (F.col("_n") - 1)).alias("mean_correlation"))


def pca_distance(cells: DataFrame) -> DataFrame:
    """Squared distance from the centre in the first five components of log1p counts."""
    result = pca(cells.withColumn("value", F.log1p(F.bround("value"))), 5, scale=False)
    return result.coordinates.groupBy("sample_id").agg(F.sum(F.col("value") * F.col("value")).alias("squared_distance"))


def tukey_flags(df: DataFrame, column: str, side: str, key: str = "sample_id") -> DataFrame:
    """Rows beyond three interquartile ranges; fewer than four rows, or a non-finite one, flag
    nothing."""
    df = cut(df)
    fences = quantiles(df, [], column, {"q1": 0.25, "q3": 0.75})
    state = df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf"))).alias("_odd"))
    width = F.col("q3") - F.col("q1")
    beyond = F.col(column) > F.col("q3") + 3 * width if side == "upper" else F.col(column) < F.col("q1") - 3 * width
    usable = (F.col("_n") >= 4) & (F.col("_odd") == 0)
    return one_row(one_row(df, fences), state).select(key, F.col(column), (usable & beyond).alias("outlier"))


def robust_z(df: DataFrame, column: str) -> DataFrame:
    """Adds `<column>_z`: distance to the median in units of 1.4826 MAD, 0 when that is zero."""
    df = cut(df)
    values = df.select(F.col(column).alias("value"))
    side = one_row(medians(values, [], "value", "_centre"), median_absolute_deviation(values, [], 1.4826))
    z = F.when(F.col("mad") > 0, (F.col(column) - F.col("_centre")) / F.col("mad")).otherwise(0.0)
    return one_row(df, side).withColumn(f"{column}_z", z).drop("_centre", "mad")


def array_qc(raw: DataFrame, normalised: DataFrame) -> DataFrame:
    """Intensity medians and quartile ranges before and after normalisation; samples whose raw
    distribution lies more than three robust z from the rest are for review."""
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}

    def spread(cells: DataFrame, prefix: str) -> DataFrame:
        return quantiles(cells, ["sample_id"], "value", wanted).select(
            "sample_id", F.col("median").alias(f"{prefix}_median"), (F.col("q3") - F.col("q1")).alias(f"{prefix}_iqr"))

    before = spread(raw.withColumn("value", F.log2(F.col("value") + 1)), "raw_log2")
    both = before.join(spread(normalised, "normalized_log2"), "sample_id")
    scored = robust_z(robust_z(both, "raw_log2_median"), "raw_log2_iqr")
    review = (F.abs("raw_log2_median_z") > 3) | (F.abs("raw_log2_iqr_z") > 3)
    return scored.select(
        *both.columns, F.when(review, "REVIEW").otherwise("PASS").alias("status"),
        F.when(review, "INTENSITY_DISTRIBUTION_OUTLIER").otherwise("").alias("reasons"))


# QC states from mild to severe.
STATUS_ORDER = ["PASS", "REVIEW", "SEVERE_REVIEW"]


def merge_status(statuses: DataFrame, key: list[str]) -> DataFrame:
    """Most severe status per key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    worst = F.max(rank).cast("int")
    return statuses.groupBy(*key).agg(F.element_at(F.array(*[F.lit(s) for s in STATUS_ORDER]), worst).alias("status"))


def filter_low_counts(cells: DataFrame, threshold: float, samples: int) -> tuple[DataFrame, DataFrame]:
    """(cells of features with `samples` counts at or above `threshold`, kept and filtered
    numbers). A threshold of zero or less keeps everything only with enough samples present."""
    per = cells.groupBy("feature_id").agg(F.count_if(F.col("value") >= threshold).alias("_k"))
    kept = per.where(F.col("_k") >= samples)
    numbers = per.agg(F.count_if(F.col("_k") >= samples).alias("features_kept"), F.count_if(F.col("_k") < samples).alias("features_filtered"))
    return spread_join(cells, kept.drop("_k"), ["feature_id"], "sample_id"), numbers


def size_factors(cells: DataFrame) -> DataFrame:
    """Median of ratios to the geometric mean, over features positive in every sample."""
    samples = cells.agg(F.count_distinct("sample_id").alias("_n"))
    means = one_row(
        cells.where("value > 0").groupBy("feature_id").agg(F.avg(F.log("value")).alias("_log_mean"), F.count(F.lit(1)).alias("_k")), samples
    ).where("_k = _n").select("feature_id", "_log_mean")
    ratios = spread_join(cells, means, ["feature_id"], "sample_id").select("sample_id", (F.log("value") - F.col("_log_mean")).alias("_ratio"))
    return medians(ratios, ["sample_id"], "_ratio", "_m").select("sample_id", F.exp("_m").alias("size_factor"))


def _upper_quartiles(cells: DataFrame, libraries: DataFrame) -> DataFrame:
    """75 % quantile of each sample's scaled counts, absent cells counting as zeros."""
    ties = cells.where("value > 0").groupBy("sample_id", "value").agg(F.count(F.lit(1)).alias("ties"))
    present = ties.groupBy("sample_id").agg(F.sum("ties").alias("_k"))
    zeros = one_row(present, feature_total(cells)).select("sample_id", F.lit(0.0).alias("value"), (F.col("feature_count") - F.col("_k")).alias("ties"))
    whole = ties.unionByName(zeros.where("ties > 0"))
    return tie_quantiles(whole, ["sample_id"], "value", {"q": 0.75}).join(libraries, "sample_id").select(
        "sample_id", (F.col("q") / F.col("library_size")).alias("f75"))


def tmm_factors(cells: DataFrame, log_ratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """Trimmed mean of M-values per sample against the sample whose upper quartile is nearest the
    mean (Robinson and Oshlack 2010); factors multiply to one."""
    cells = cut(cells.where("value > 0").select("feature_id", "sample_id", "value"))
    libraries = cells.groupBy("sample_id").agg(F.sum("value").alias("library_size"))
    quartiles = _upper_quartiles(cells, libraries)
    quartiles = cut(quartiles)
    nearest = one_row(quartiles, quartiles.agg(F.avg("f75").alias("_mean"))).agg(
        F.min_by("sample_id", F.struct(F.abs(F.col("f75") - F.col("_mean")), F.col("sample_id"))).alias("_ref"))
    with_ref = one_row(cells.join(libraries, "sample_id"), nearest)
    ref = with_ref.where(F.col("sample_id") == F.col("_ref")).select(
        "feature_id", F.col("value").alias("_rv"), F.col("library_size").alias("_rl"))
    obs, r = F.col("value") / F.col("library_size"), F.col("_rv") / F.col("_rl")
    pairs = cut(spread_join(with_ref.drop("_ref"), ref, ["feature_id"], "sample_id").select(
        "sample_id", "feature_id", F.log2(obs / r).alias("m"), ((F.log2(obs) + F.log2(r)) / 2).alias("a"),
        ((F.col("library_size") - F.col("value")) / F.col("library_size") / F.col("value")
         + (F.col("_rl") - F.col("_rv")) / F.col("_rl") / F.col("_rv")).alias("v")))
    size = pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("m")).alias("_far"))
    ranked = pairs
    for value, rank in (("m", "_rm"), ("a", "_ra")):
        places = average_ranks(pairs, ["sample_id"], value).select("sample_id", value, F.col("avg_rank").alias(rank), "ties")
        ranked = counted_join(ranked, places, ["sample_id", value], "ties").drop("ties")
    ranked = spread_join(ranked, size, ["sample_id"], "feature_id")
    low_m, low_a = F.floor(F.col("_n") * log_ratio_trim) + 1, F.floor(F.col("_n") * sum_trim) + 1
    inside = F.col("_rm").between(low_m, F.col("_n") + 1 - low_m) & F.col("_ra").between(low_a, F.col("_n") + 1 - low_a)
    per = ranked.groupBy("sample_id").agg(
        F.sum(F.when(inside, F.col("m") / F.col("v"))).alias("_wm"), F.sum(F.when(inside, 1 / F.col("v"))).alias("_w"), F.max("_far").alias("_far"))
    log_factor = F.when((F.col("_far") < 1e-6) | F.col("_w").isNull() | (F.col("_w") == 0), 0.0).otherwise(F.col("_wm") / F.col("_w"))
    factors = libraries.join(per, "sample_id", "left").select("sample_id", "library_size", F.coalesce(log_factor, F.lit(0.0)).alias("_f"))
    factors = cut(factors)
    return one_row(factors, factors.agg(F.avg("_f").alias("_mean"))).select(
        "sample_id", "library_size", F.pow(F.lit(2.0), F.col("_f") - F.col("_mean")).alias("norm_factor"))


def log_cpm_tmm(cells: DataFrame, factors: DataFrame, prior: float = 2.0) -> DataFrame:
    """Log counts per million on effective libraries with a library-scaled prior. The value of an
    absent cell is the same formula at count 0, returned by `log_cpm_floor`."""
    scale = _effective(factors, prior)
    joined = spread_join(cells, scale, ["sample_id"], "feature_id")
    return joined.select("feature_id", "sample_id", F.log2((F.col("value") + F.col("_prior")) / F.col("_size") * 1e6).alias("value"))


def log_cpm_floor(factors: DataFrame, prior: float = 2.0) -> DataFrame:
    return _effective(factors, prior).select("sample_id", F.log2(F.col("_prior") / F.col("_size") * 1e6).alias("value"))


def _effective(factors: DataFrame, prior: float) -> DataFrame:
    sized = factors.select("sample_id", (F.col("library_size") * F.col("norm_factor")).alias("_lib"))
    scaled = one_row(sized, sized.agg(F.avg("_lib").alias("_mean"))).withColumn("_prior", F.lit(prior) * F.col("_lib") / F.col("_mean"))
    return scaled.select("sample_id", "_prior", (F.col("_lib") + 2 * F.col("_prior")).alias("_size"))

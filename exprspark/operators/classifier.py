"""Elastic-net classifiers validated without leakage: everything is fitted inside the training fold.

Inputs: long cells, and `labels` (sample_id, y, group) with y = 0/1 or a class name. Fold membership
and every other draw are hashes of (seed, repeat, unit).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.draws import draw, draw_wide
from exprspark.functions.ordering import one_row, row_numbers
from exprspark.functions.text import is_missing
from exprspark.operators import folds as R
from exprspark.operators import passes as N
from exprspark.operators.matrix import feature_moments
from exprspark.operators.metrics import binary_metrics, logistic_line, logistic_lines, multiclass_metrics, ranking_metrics, score_counts, youden
from exprspark.operators.predict import model_digests, sigmoid
from exprspark.operators.validate import finding, union_all
from exprspark.session import cut

# The tuning grid, in the order in which equal scores are resolved.
CANDIDATES = [(c, ratio) for c in (0.05, 0.5, 5.0) for ratio in (0.0, 0.5, 1.0)]
# The tree grids, trees of a forest, and rounds of boosting.
FOREST_CANDIDATES = [{"depth": None, "least": 1}, {"depth": 5, "least": 3}]
BOOST_CANDIDATES = [{"leaves": 7, "ridge": 0.0}, {"leaves": 15, "ridge": 1.0}]
FOREST_TREES, BOOSTING_ROUNDS = 100, 100
#: Levels that the distributed trees take for unlimited depth, and for so many leaves.
DEEPEST, LEVELS = 30, {7: 3, 15: 4}


CELLS_PER_PARTITION = 500_000
# Fixed value: iterations after which a fit counts as failed.
MAX_ITERATIONS = 20_000


@dataclass
class Config:
    features: int = 500
    outer_folds: int = 5
    inner_folds: int = 4
    repeats: int = 3
    seed: int = 0
    balanced: bool = True
    metric: str = "roc_auc"
    calibrate: bool = True
    tune_threshold: bool = True
    candidates: list[tuple[float, float]] = field(default_factory=lambda: list(CANDIDATES))
    threads: int = 8


# ---- design audit and folds


def audit_classifier(meta: DataFrame, outcome: str, folds: int, group: str | None = None, positive: str | None = None) -> DataFrame:
    """Findings before any fit: class count, missing values, units per class, imbalance, size."""
    y = F.trim(F.col(outcome).cast("string"))
    classes = meta.where(~is_missing(y)).groupBy(y.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), *([F.count_distinct(group).alias("units")] if group else [F.count(F.lit(1)).alias("units")]))
    totals = classes.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("all"),
                         F.count_if(F.col("level") == F.lit(positive or "")).alias("positive"))
    binary = positive is not None
    wrong = F.col("k") != 2 if binary else ~F.col("k").between(3, 20)
    parts = [
        finding(meta.agg(F.count_if(is_missing(y)).alias("m")).where("m > 0"), "CLASSIFIER.OUTCOME_MISSING"),
        finding(totals.where(wrong), "CLASSIFIER.CLASS_COUNT", F.col("k").cast("string")),
        finding(classes.where(F.col("units") < folds), "CLASSIFIER.UNITS_PER_CLASS", F.col("level")),
        finding(totals.where(F.col("low") / F.col("high") < 0.25), "CLASSIFIER.SEVERE_IMBALANCE", severity="WARNING"),
        finding(totals.where(F.col("all") < 50), "CLASSIFIER.FEW_SAMPLES", severity="WARNING"),
    ]
    if binary:
        parts.append(finding(totals.where("positive = 0"), "CLASSIFIER.POSITIVE_CLASS_ABSENT", F.lit(positive)))
    if group:
        parts.append(finding(meta.agg(F.count_if(is_missing(F.col(group).cast("string"))).alias("m")).where("m > 0"), "CLASSIFIER.GROUP_MISSING"))
        parts.append(finding(meta.agg(F.count_distinct(group).alias("g")).where(F.col("g") < folds), "CLASSIFIER.TOO_FEW_GROUPS"))
    else:
        parts.append(finding(totals, "CLASSIFIER.NO_GROUP_SELECTED", severity="WARNING"))
    return union_all(parts)


# Column names that usually hold the experimental unit.
UNIT_NAMES = ["donor", "donor_id", "subject", "subject_id", "patient", "patient_id", "participant", "participant_id", "individual", "individual_id"]


def hidden_units(profile: DataFrame, samples: int) -> DataFrame:
    """Unit-like metadata columns with repeats, which ought to be the group column."""
    name = F.regexp_replace(F.lower(F.trim("variable")), "[- ]", "_")
    return profile.where(name.isin(UNIT_NAMES) & (F.col("unique_count") > 1) & (F.col("unique_count") < samples) & (F.col("missing_count") == 0))


def _units(labels: DataFrame) -> DataFrame:
    """(unit, stratum): a unit's most frequent class, ties to the first label."""
    unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
    counts = labels.groupBy(unit.alias("unit"), F.col("y").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("unit").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("stratum"))


def assign_folds(labels: DataFrame, folds: int, repeats: int, seed: int) -> DataFrame:
    """(repeat, sample_id, fold) with whole units in one fold: within each class, units are dealt in
    the order of their draw, from a class-specific first fold."""
    dealt = _units(labels).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    keyed = dealt.withColumn("_key", draw_wide(seed, F.col("repeat"), F.col("unit")))
    numbered = row_numbers(keyed, ["repeat", "stratum"], ["_key", "unit"], "_rn")
    fold = F.pmod(F.col("_rn") - 1 + draw(seed, F.col("repeat"), F.col("stratum")), F.lit(folds)) + 1
    unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
    return labels.withColumn("unit", unit).join(numbered.select("repeat", "unit", fold.cast("int").alias("fold")), "unit").select(
        "repeat", "sample_id", "group", "y", "fold")


def fold_plan(assigned: DataFrame) -> DataFrame:
    """Per repeat and fold: training and test samples, positives or classes, units, shared units."""
    unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
    per = assigned.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("test_sample_count"), F.count_distinct(unit).alias("test_group_count"), F.count_distinct("y").alias("test_class_count"))
    whole = assigned.groupBy("repeat").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(unit).alias("_g"))
    spread = assigned.groupBy("repeat", unit.alias("unit")).agg(F.count_distinct("fold").alias("k"), F.collect_set("fold").alias("folds")).where("k > 1")
    shared = spread.select("repeat", F.explode("folds").alias("fold")).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("group_overlap_count"))
    return per.join(whole, "repeat").join(shared, ["repeat", "fold"], "left").select(
        "repeat", "fold", (F.col("_n") - F.col("test_sample_count")).alias("training_sample_count"), "test_sample_count", "test_class_count",
        (F.col("_g") - F.col("test_group_count") + F.coalesce("group_overlap_count", F.lit(0))).alias("training_group_count"), "test_group_count",
        F.coalesce("group_overlap_count", F.lit(0)).alias("group_overlap_count"))


def class_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("repeat", "fold", "y").agg(F.count(F.lit(1)).alias("n"))


def check_leakage(assigned: DataFrame) -> DataFrame:
    """Units that sit in more than one fold of a repeat; must be empty."""
    unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
    return assigned.groupBy("repeat", unit.alias("unit")).agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def check_oof(predictions: DataFrame, labels: DataFrame, repeats: int) -> DataFrame:
    """(sample_id, repeat) without exactly one out-of-fold prediction; must be empty."""
    wanted = labels.select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    seen = predictions.groupBy("sample_id", "repeat").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(seen, ["sample_id", "repeat"], "full_outer").select("sample_id", "repeat", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


# ---- one fit


@dataclass
class Prepared:
    """Scaled vectors of the training rows and of the rows to score, and how they were scaled."""

    train: DataFrame  # weighted
    test: DataFrame
    selected: DataFrame  # feature_id, i, mean, sd
    samples: int


def prepare_fold(cells: DataFrame, train: DataFrame, test: DataFrame, features: int, balanced: bool = True) -> Prepared:
    """Variance filter and scaling learnt from the training samples only. Vectors hold value/sd:
    centring would only move the unpenalised intercept, so absent cells stay absent."""
    samples = train.count()
    inside = cells.join(train.select("sample_id"), "sample_id", "left_semi")
    moments = feature_moments(inside, samples)
    best = moments.orderBy(F.desc(F.round("var_samp", 12)), "feature_id").limit(features)
    numbered = row_numbers(best, [], ["feature_id"], "_rn")
    sd = F.when(F.col("var_pop") > 0, F.sqrt("var_pop")).otherwise(1.0)
    selected = cut(numbered.select("feature_id", (F.col("_rn") - 1).cast("int").alias("i"), "mean", sd.alias("sd")))
    size = selected.count()
    # every step of a fit runs one task per partition: small folds need few
    partitions = max(1, samples * size // CELLS_PER_PARTITION)

    def vectors(rows: DataFrame) -> DataFrame:
        scaled = cells.join(rows.select("sample_id"), "sample_id", "left_semi").join(selected, "feature_id")
        entry = F.struct("i", (F.col("value") / F.col("sd")).alias("v"))
        # at most `features` entries per sample
        per = scaled.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(entry)).alias("e"))
        full = rows.join(per, "sample_id", "left")
        dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("e", i), F.lit(0.0))) if size else F.array().cast("array<double>")
        return full.select(*rows.columns, array_to_vector(dense).alias("features")).repartition(partitions)

    return Prepared(vectors(_with_weights(train, balanced)).persist(), vectors(test).persist(), selected, samples)


def _with_weights(rows: DataFrame, balanced: bool) -> DataFrame:
    if not balanced:
        return rows.withColumn("weight", F.lit(1.0))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))  # one row per class
    whole = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return one_row(rows.join(F.broadcast(counts), "label"), whole).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def fit_enet(prepared: Prepared, c: float, ratio: float, family: str = "binomial"):
    """Elastic-net logistic fit with the library objective C * loss + penalty: the same optimum as a
    mean loss with penalty 1 / (C n)."""
    model = LogisticRegression(
        regParam=1.0 / (c * prepared.samples), elasticNetParam=ratio, standardization=False, weightCol="weight", family=family, tol=1e-6, maxIter=MAX_ITERATIONS)
    fitted = model.fit(prepared.train)
    if fitted.summary.totalIterations >= MAX_ITERATIONS:
        raise RuntimeError(f"The elastic net did not converge in {MAX_ITERATIONS} iterations.")
    return fitted


def _decision(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn("decision", vector_to_array("rawPrediction")[1])


def _release(prepared: list[Prepared]) -> None:
    for p in prepared:
        p.train.unpersist()
        p.test.unpersist()


def _pool(threads: int, tasks: list):
    """Fits are independent Spark jobs; a few driver threads keep the executors busy."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda task: task(), tasks))


def _rows(labels: DataFrame) -> DataFrame:
    return labels.select("sample_id", "group", F.col("y").cast("double").alias("label"))


def _score_by(pred: DataFrame, by: list[str], metric: str) -> dict:
    """Metric per candidate (per group and candidate with two keys); `pred` has y and p."""
    if metric in ("roc_auc", "pr_auc"):
        rows = ranking_metrics(score_counts(pred, by), by).select(*by, metric).collect()  # one per candidate
    else:
        rows = binary_metrics(pred.withColumn("predicted", F.col("p") >= 0.5), by).select(*by, metric).collect()
    return {r[0] if len(by) == 1 else tuple(r[:-1]): r[-1] for r in rows}


def _first_best(values: list[float]) -> int:
    """A later candidate must be better by more than 1e-12."""
    best, top = 0, float("-inf")
    for index, value in enumerate(values):
        if value > top + 1e-12:
            best, top = index, value
    return best


# ---- many training sets at once


def _inner_parts(train: DataFrame, seeds: dict[int, int], folds: int) -> DataFrame:
    """(grp, sample_id, part): the inner fold of every training sample of every group, drawn as `assign_folds` draws it with the group's seed."""
    seed = F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair])[F.col("grp")]
    unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
    own = train.withColumn("unit", unit)
    counts = own.groupBy("grp", "unit", F.col("y").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    units = counts.groupBy("grp", "unit").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("stratum")).withColumn("_seed", seed)
    keyed = units.withColumn("_key", draw_wide(F.col("_seed"), 1, F.col("unit")))
    numbered = row_numbers(keyed, ["grp", "stratum"], ["_key", "unit"], "_rn")
    fold = F.pmod(F.col("_rn") - 1 + draw(F.col("_seed"), 1, F.col("stratum")), F.lit(folds)) + 1
    return own.join(numbered.select("grp", "unit", fold.cast("int").alias("part")), ["grp", "unit"]).select("grp", "sample_id", "part")


def _tuned(packed: N.Packed, groups: int, config: Config, classes: list, with_test: bool):
    """(best candidate of every group, its inner decisions, scales): all candidates of all inner folds of all groups in the same passes."""
    inner = [(g, k) for g in range(groups) for k in range(1, config.inner_folds + 1)]
    ends = [(g, 0) for g in range(groups)] if with_test else []
    scale = N.scales(packed, inner + ends, config.features, len(classes), config.balanced)
    models = [N.Model(g, k, j, c, ratio) for g, k in inner for j, (c, ratio) in enumerate(config.candidates)]
    decisions = cut(N.score(packed, N.fit(packed, models, {key: scale[key] for key in inner}, len(classes))))
    keys = ["grp", "candidate"]
    if len(classes) == 2:
        values = _score_by(decisions.select(*keys, "y", sigmoid(F.col("decision")[0]).alias("p")), keys, config.metric)
    else:
        metric = _multiclass(config).metric
        values = {(r["grp"], r["candidate"]): r[metric] for r in multiclass_metrics(cut(_class_rows(decisions, classes, *keys)), keys).collect()}
    best = {g: _first_best([values[g, j] for j in range(len(config.candidates))]) for g in range(groups)}
    chosen = F.create_map(*[F.lit(x) for pair in best.items() for x in pair])[F.col("grp")]
    return best, decisions.where(F.col("candidate") == chosen), scale


def _class_rows(decisions: DataFrame, classes: list, *keys: str) -> DataFrame:
    """Softmax of the decisions as a row per class: keys, sample_id, observed, class, probability."""
    names = F.array(*[F.lit(c) for c in classes])
    powers = F.transform("decision", lambda d: F.exp(d - F.array_max("decision")))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    spread = decisions.select(*keys, "sample_id", F.get(names, F.col("y")).alias("observed"), powers.alias("_e")).withColumn("_s", total)
    rows = spread.select(*keys, "sample_id", "observed", "_s", F.posexplode("_e").alias("_i", "_v"))
    return rows.select(*keys, "sample_id", "observed", F.get(names, F.col("_i")).alias("class"), (F.col("_v") / F.col("_s")).alias("probability"))


def _packed_folds(cells: DataFrame, labels: DataFrame, placed: DataFrame, config: Config, features: list[str]) -> tuple[N.Packed, list[tuple[int, int]]]:
    """Packed rows with a group per (repeat, outer fold). placed: repeat, fold, sample_id, y, group."""
    groups = [(repeat, fold) for repeat in range(1, config.repeats + 1) for fold in range(1, config.outer_folds + 1)]
    seeds = {g: R.seed_of(config.seed, "inner", *key) for g, key in enumerate(groups)}
    other = F.explode(F.sequence(F.lit(1), F.lit(config.outer_folds))).alias("_outer")
    train = placed.select("*", other).where("fold <> _outer").withColumn("grp", (F.col("repeat") - 1) * config.outer_folds + F.col("_outer") - 1)
    return N.pack(cells, labels, _inner_parts(train, seeds, config.inner_folds), len(groups), features), groups


def _nested_in_passes(cells: DataFrame, labels: DataFrame, placed: DataFrame, config: Config, features: list[str]) -> Validation:
    packed, groups = _packed_folds(cells, labels, placed, config, features)
    best, held, scale = _tuned(packed, len(groups), config, [0, 1], True)
    held = held.select("grp", "y", F.col("decision")[0].alias("decision"))
    lines = {g: (0.0, 1.0) for g in best}
    if config.calibrate:
        lines = logistic_lines(held.groupBy("grp", F.col("decision").alias("x")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")), "grp", ridge=1e-6)
    spark = cells.sparkSession
    table = spark.createDataFrame([(g, *groups[g], *lines[g]) for g in best], "grp int, repeat int, fold int, _a double, _b double")
    p = sigmoid(F.col("_a") + F.col("_b") * F.col("decision"))
    thresholds = {g: 0.5 for g in best}
    if config.tune_threshold:
        thresholds = {r["grp"]: float(r["threshold"]) for r in youden(held.join(F.broadcast(table), "grp").select("grp", "y", p.alias("p")), ["grp"]).collect()}
    models = [N.Model(g, 0, j, *config.candidates[j]) for g, j in best.items()]
    fits = N.fit(packed, models, {(m.group, 0): scale[m.group, 0] for m in models}, 2)
    cutoff = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("grp")]
    scored = N.score(packed, fits).withColumn("decision", F.col("decision")[0]).join(F.broadcast(table), "grp").select(
        "repeat", "fold", "sample_id", "y", p.alias("p"), cutoff.alias("_cutoff"))
    predictions = cut(scored.join(labels.select("sample_id", F.col("group").cast("string").alias("group")), "sample_id").select(
        "repeat", "fold", "sample_id", "group", "y", "p", (F.col("p") >= F.col("_cutoff")).alias("predicted")))
    rows = [(*groups[m.group], features[f], float(v)) for m, point in zip(models, fits.points) for f, v in zip(fits.scales[m.group, 0].kept, point[0])]
    records = [Fold(*groups[g], *config.candidates[j], thresholds[g]) for g, j in best.items()]
    return Validation(predictions, spark.createDataFrame(rows, "repeat int, fold int, feature_id string, coefficient double"), records)


def tune(cells: DataFrame, labels: DataFrame, config: Config, seed: int) -> tuple[tuple[float, float], DataFrame]:
    """Best (C, ratio) over inner folds, and its inner decisions (sample_id, y, decision). A later
    candidate must be better by more than 1e-12."""
    cohort = R.gather(cells, labels) if config.metric in R.METRICS else None
    if cohort is not None:
        fit = cut(R.run(cells, cohort, config, 2, whole=True, seed=seed))
        return config.candidates[fit.first()["candidate"]], fit.select(F.explode("decisions").alias("x")).select("x.*")
    if (names := N.fits_here(cells, labels, config.features, 2)) is not None:
        packed = N.pack(cells, labels, _inner_parts(labels.withColumn("grp", F.lit(0)), {0: seed}, config.inner_folds), 1, names)
        best, held, _ = _tuned(packed, 1, config, [0, 1], False)
        return config.candidates[best[0]], held.select("sample_id", "y", F.col("decision")[0].alias("decision"))
    folds = cut(assign_folds(labels, config.inner_folds, 1, seed))
    tasks, prepared = [], []
    for fold in range(1, config.inner_folds + 1):
        p = prepare_fold(cells, _rows(folds.where(F.col("fold") != fold)), _rows(folds.where(F.col("fold") == fold)), config.features, config.balanced)
        prepared.append(p)
        for index, (c, ratio) in enumerate(config.candidates):
            def job(p=p, c=c, ratio=ratio, index=index):
                model = fit_enet(p, c, ratio)
                return _decision(model, p.test).select("sample_id", F.col("label").cast("int").alias("y"), F.lit(index).alias("candidate"), "decision")

            tasks.append(job)
    decisions = cut(union_all(_pool(config.threads, tasks)))
    _release(prepared)
    scores = _score_by(decisions.withColumn("p", sigmoid(F.col("decision"))), ["candidate"], config.metric)
    best = _first_best([scores[index] for index in range(len(config.candidates))])
    return config.candidates[best], decisions.where(F.col("candidate") == best).drop("candidate")


def fit_calibrator(decisions: DataFrame) -> tuple[float, float]:
    """(intercept, slope) of a practically unpenalised logistic fit on the decisions."""
    points = decisions.groupBy(F.col("decision").alias("x")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    return logistic_line(points, ridge=1e-6)


def _calibrated(decision: Column, line: tuple[float, float] | None) -> Column:
    return sigmoid(decision) if line is None else sigmoid(F.lit(line[0]) + F.lit(line[1]) * decision)


@dataclass
class Fold:
    repeat: int
    fold: int
    c: float
    ratio: float
    threshold: float


@dataclass
class Validation:
    predictions: DataFrame  # repeat, fold, sample_id, group, y, p, predicted
    coefficients: DataFrame  # repeat, fold, feature_id, coefficient
    folds: list[Fold]


def _coefficients(model, prepared: Prepared) -> DataFrame:
    values = [float(v) for v in model.coefficients.toArray()]  # at most config.features
    rows = prepared.selected.sparkSession.createDataFrame(list(enumerate(values)), "i int, coefficient double")
    return prepared.selected.join(rows, "i").select("feature_id", "mean", "sd", "coefficient")


def nested_cv(cells: DataFrame, labels: DataFrame, config: Config, fold_labels: DataFrame | None = None) -> Validation:
    """Repeated outer folds; inside each, tuning, calibration, threshold and the fit see training
    samples only. `fold_labels` fixes the folds when `labels` are permuted. A cohort small enough to be broadcast is fitted
    one outer fold a task, a larger one in passes over its rows that serve all folds and candidates, and one of too many features by one distributed fit
    after another; the folds and the optima are the same."""
    if fold_labels is None and config.metric in R.METRICS and (cohort := R.gather(cells, labels)) is not None:
        return _nested_in_tasks(cells, labels, cohort, config)
    names = N.fits_here(cells, labels, config.features, 2)
    cells = cut(cells) if names is None else cells
    assigned = cut(assign_folds(fold_labels if fold_labels is not None else labels, config.outer_folds, config.repeats, config.seed))
    if not check_leakage(assigned).isEmpty():
        raise ValueError("A unit sits in more than one outer fold.")
    placed = assigned.select("repeat", "fold", "sample_id").join(labels, "sample_id")
    if names is not None:
        out = _nested_in_passes(cells, labels, placed, config, names)
        if not check_oof(out.predictions, labels, config.repeats).isEmpty():
            raise ValueError("Every sample needs exactly one out-of-fold prediction per repeat.")
        return out
    predictions, coefficients, records = [], [], []
    for repeat in range(1, config.repeats + 1):
        for fold in range(1, config.outer_folds + 1):
            here = placed.where(F.col("repeat") == repeat)
            train, test = here.where(F.col("fold") != fold), here.where(F.col("fold") == fold)
            train_labels = cut(train.select("sample_id", "y", "group"))
            (c, ratio), decisions = tune(cells, train_labels, config, R.seed_of(config.seed, "inner", repeat, fold))
            line = fit_calibrator(decisions) if config.calibrate else None
            threshold = 0.5
            if config.tune_threshold:
                threshold = float(youden(decisions.select("y", _calibrated(F.col("decision"), line).alias("p"))).first()["threshold"])
            p = prepare_fold(cells, _rows(train_labels), _rows(test), config.features, config.balanced)
            model = fit_enet(p, c, ratio)
            scored = _decision(model, p.test).withColumn("p", _calibrated(F.col("decision"), line))
            predictions.append(cut(scored.select(
                F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "sample_id", "group", F.col("label").cast("int").alias("y"), "p",
                (F.col("p") >= threshold).alias("predicted"))))
            coefficients.append(_coefficients(model, p).select(F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "feature_id", "coefficient"))
            records.append(Fold(repeat, fold, c, ratio, threshold))
            _release([p])
    out = Validation(union_all(predictions), union_all(coefficients), records)
    if not check_oof(out.predictions, labels, config.repeats).isEmpty():
        raise ValueError("Every sample needs exactly one out-of-fold prediction per repeat.")
    return out


def _nested_in_tasks(cells: DataFrame, labels: DataFrame, cohort: R.Cohort, config: Config) -> Validation:
    fits = cut(R.run(cells, cohort, config, 2))
    own = fits.select("repeat", "fold", "threshold", F.explode("predictions").alias("x")).select("repeat", "fold", "threshold", "x.sample_id", "x.y", F.col("x.chance")[0].alias("p"))
    predictions = own.join(labels.select("sample_id", F.col("group").cast("string").alias("group")), "sample_id").select(
        "repeat", "fold", "sample_id", "group", "y", "p", (F.col("p") >= F.col("threshold")).alias("predicted"))
    coefficients = fits.select("repeat", "fold", F.explode("coefficients").alias("x")).select("repeat", "fold", "x.feature_id", (F.col("x.values")[0]).alias("coefficient"))
    records = [Fold(r["repeat"], r["fold"], *config.candidates[r["candidate"]], r["threshold"]) for r in fits.select("repeat", "fold", "candidate", "threshold").orderBy("repeat", "fold").collect()]
    out = Validation(predictions, coefficients, records)
    if not check_oof(out.predictions, labels, config.repeats).isEmpty():
        raise ValueError("Every sample needs exactly one out-of-fold prediction per repeat.")
    return out


def stability(coefficients: DataFrame, folds: int) -> DataFrame:
    """How often a feature was selected and kept, and its mean coefficient."""
    return coefficients.groupBy("feature_id").agg(
        (F.count(F.lit(1)) / folds).alias("selection_frequency"), (F.count_if(F.abs("coefficient") > 1e-12) / folds).alias("nonzero_frequency"),
        F.avg("coefficient").alias("mean_coefficient"))


# ---- controls


def permute_labels(labels: DataFrame, seed: int, permutation: int) -> DataFrame:
    """Labels shuffled between units when every unit has one class, else within units; without
    units, between samples."""
    mixed = labels.where("group is not null").groupBy("group").agg(F.count_distinct("y").alias("k")).where("k > 1")
    grouped = not labels.where("group is not null").isEmpty()
    if grouped and not mixed.isEmpty():
        target, by = labels.select("sample_id", "group", "y"), ["group"]
        unit = "sample_id"
    elif grouped:
        target, by, unit = labels.groupBy("group").agg(F.min("y").alias("y")), [], "group"
    else:
        target, by, unit = labels.select("sample_id", "y"), [], "sample_id"
    ordered = row_numbers(target, by, [unit], "_at")
    drawn = row_numbers(target.withColumn("_key", draw_wide(seed, permutation, F.col(unit))), by, ["_key", unit], "_at")
    swapped = ordered.drop("y").join(drawn.select(*by, "_at", "y"), [*by, "_at"]).drop("_at")
    if unit == "group":
        return labels.drop("y").join(swapped, "group").select("sample_id", "y", "group")
    return labels.select("sample_id", "group").join(swapped.select("sample_id", "y"), "sample_id").select("sample_id", "y", "group")


def permutation_control(cells: DataFrame, labels: DataFrame, config: Config, permutations: int) -> DataFrame:
    """The whole validation, as it is and on permuted labels over the original folds: (permutation, roc_auc, observed_roc_auc,
    empirical_p_value). Every permuted outer fold is a row of one job; beyond the size that is broadcast the
    permutations are validated one after another by distributed fits."""
    cohort = R.gather(cells, labels) if config.metric in R.METRICS else None
    if cohort is not None:
        chance = F.explode("predictions").alias("x")
        pooled = R.run(cells, cohort, config, 2, permutations).select("permutation", chance).select("permutation", "x.y", F.col("x.chance")[0].alias("p"))
        return _against_observed(ranking_metrics(score_counts(cut(pooled), ["permutation"]), ["permutation"]), "roc_auc", permutations)
    parts = [nested_cv(cells, labels, config).predictions.select(F.lit(-1).alias("permutation"), "y", "p")]
    for permutation in range(permutations):
        permuted = cut(permute_labels(labels, R.seed_of(config.seed, "permute"), permutation))
        parts.append(nested_cv(cells, permuted, config, fold_labels=labels).predictions.select(F.lit(permutation).alias("permutation"), "y", "p"))
    return _against_observed(ranking_metrics(score_counts(union_all(parts), ["permutation"]), ["permutation"]), "roc_auc", permutations)


def _against_observed(scores: DataFrame, metric: str, permutations: int) -> DataFrame:
    """Each permutation's score beside the observed one (permutation -1) and the share that reaches it."""
    scores = cut(scores.select("permutation", metric))
    observed = scores.where("permutation = -1").select(F.col(metric).alias(f"observed_{metric}"))
    beside = one_row(scores.where("permutation >= 0"), observed)
    reached = beside.agg(((1 + F.count_if(F.col(metric) >= F.col(f"observed_{metric}"))) / F.lit(permutations + 1)).alias("empirical_p_value"))
    return one_row(beside, reached)


def permutation_control_multiclass(cells: DataFrame, labels: DataFrame, config: Config, permutations: int) -> DataFrame:
    """The same for several classes: (permutation, macro_roc_auc, observed_macro_roc_auc, empirical_p_value)."""
    classes, coded = _coded(labels)
    cohort = R.gather(cells, coded)
    if cohort is not None:
        long = _long_rows(R.run(cells, cohort, _multiclass(config), len(classes), permutations), classes)
    else:
        parts = [nested_cv_multiclass(cells, labels, config)[0].withColumn("permutation", F.lit(-1))]
        names = F.array(*[F.lit(c) for c in classes])
        for permutation in range(permutations):
            permuted = cut(permute_labels(coded, R.seed_of(config.seed, "permute"), permutation)).withColumn("y", F.get(names, F.col("y").cast("int")))
            parts.append(nested_cv_multiclass(cells, permuted, config, fold_labels=labels)[0].withColumn("permutation", F.lit(permutation)))
        long = union_all(parts)
    return _against_observed(multiclass_metrics(cut(long.drop("group")), ["permutation"]), "macro_roc_auc", permutations)


def learning_curve(cells: DataFrame, labels: DataFrame, validation: Validation, config: Config, fractions: Sequence[float] = (0.5, 0.75, 1.0)) -> DataFrame:
    """Mean fold ROC area when only a share of each fold's training units is used, at the fold's own
    tuned parameters."""
    if (names := N.fits_here(cells, labels, config.features, 2)) is not None:
        return _curve_in_passes(cells, labels, validation, config, fractions, names)
    folds = validation.predictions.select("repeat", "fold", "sample_id")
    tasks = []
    for fraction in fractions:
        for record in validation.folds:
            def job(fraction=fraction, record=record):
                here = folds.where(F.col("repeat") == record.repeat).join(labels, "sample_id")
                train, test = here.where(F.col("fold") != record.fold), here.where(F.col("fold") == record.fold)
                unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
                units = train.select(unit.alias("unit")).distinct()
                keep = max(2, round(units.count() * fraction))
                chosen = units.orderBy(draw_wide(config.seed, record.repeat, record.fold, F.col("unit")), "unit").limit(keep)
                part = train.withColumn("unit", unit).join(chosen, "unit", "left_semi").drop("unit")
                if part.select("y").distinct().count() != 2:
                    part = train
                p = prepare_fold(cells, _rows(part), _rows(test), config.features, config.balanced)
                scored = _decision(fit_enet(p, record.c, record.ratio), p.test)
                auc = ranking_metrics(score_counts(scored.select(F.col("label").cast("int").alias("y"), F.col("decision").alias("p")))).first()["roc_auc"]
                _release([p])
                return fraction, record.repeat, record.fold, float(auc)

            tasks.append(job)
    rows = _pool(config.threads, tasks)
    return cells.sparkSession.createDataFrame(rows, "training_fraction double, repeat int, fold int, roc_auc double")


def _curve_in_passes(cells: DataFrame, labels: DataFrame, validation: Validation, config: Config, fractions: Sequence[float], names: list[str]) -> DataFrame:
    """All shares of all folds in the same passes: a group each, part 1 for the training samples of the share, 0 for the test samples."""
    spark = cells.sparkSession
    records = spark.createDataFrame([(i, r.repeat, r.fold) for i, r in enumerate(validation.folds)], "_r int, repeat int, _fold int")
    unit = F.coalesce(F.col("group").cast("string"), F.col("sample_id"))
    here = cut(validation.predictions.select("repeat", "fold", "sample_id").join(labels.select("sample_id", "y", unit.alias("unit")), "sample_id").join(F.broadcast(records), "repeat"))
    train = here.where("fold <> _fold")
    units = train.select("_r", "repeat", "_fold", "unit").distinct().withColumn("_key", draw_wide(config.seed, F.col("repeat"), F.col("_fold"), F.col("unit")))
    numbered = row_numbers(units, ["_r"], ["_key", "unit"], "_rn").select("_r", "unit", "_rn")
    sizes = numbered.groupBy("_r").agg(F.max("_rn").alias("_n"))
    shares = F.posexplode(F.array(*[F.lit(float(f)) for f in fractions])).alias("_f", "_share")
    grp = (F.col("_f") * len(validation.folds) + F.col("_r")).alias("grp")
    placed = cut(train.join(numbered, ["_r", "unit"]).join(F.broadcast(sizes), "_r").select("*", shares).select(
        grp, "sample_id", "y", (F.col("_rn") <= F.greatest(F.lit(2), F.bround(F.col("_n") * F.col("_share")))).alias("_in")))
    whole = placed.groupBy("grp").agg((F.count_distinct(F.when(F.col("_in"), F.col("y"))) != 2).alias("_all"))
    used = placed.join(F.broadcast(whole), "grp").select("grp", "sample_id", F.when(F.col("_in") | F.col("_all"), 1).otherwise(-1).alias("part"))
    keys = [(f, r) for f in fractions for r in validation.folds]
    packed = N.pack(cells, labels, used, len(keys), names)
    problems = [(g, 0) for g in range(len(keys))]
    scale = N.scales(packed, problems, config.features, 2, config.balanced)
    fits = N.fit(packed, [N.Model(g, 0, 0, r.c, r.ratio) for g, (_, r) in enumerate(keys)], scale, 2)
    areas = _score_by(cut(N.score(packed, fits).select("grp", "y", F.col("decision")[0].alias("p"))), ["grp"], "roc_auc")
    rows = [(float(f), r.repeat, r.fold, float(areas[g])) for g, (f, r) in enumerate(keys)]
    return spark.createDataFrame(rows, "training_fraction double, repeat int, fold int, roc_auc double")


def _tree(algorithm: str, parameters: dict, seed: int):
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=FOREST_TREES, seed=seed, weightCol="weight", maxDepth=min(parameters["depth"] or DEEPEST, DEEPEST), minInstancesPerNode=parameters["least"])
    return GBTClassifier(maxIter=BOOSTING_ROUNDS, seed=seed, weightCol="weight", minInstancesPerNode=5, maxDepth=LEVELS.get(parameters["leaves"], 4))


def compare_models(cells: DataFrame, labels: DataFrame, config: Config, grids: dict[str, list[dict]] | None = None) -> DataFrame:
    """The elastic net, a forest and boosted trees on the same outer folds, tuned on the same inner folds: (method, metrics).

    In a cohort that is broadcast, boosting grows leaf by leaf to 7 or 15 leaves with an L2 term of 0 or 1, and forests grow until pure. Beyond it
    the distributed trees take 3 or 4 levels and up to 30."""
    cells = cut(cells)
    grids = grids or {"random_forest": FOREST_CANDIDATES, "boosted_trees": BOOST_CANDIDATES}
    net = nested_cv(cells, labels, config).predictions.select(F.lit("elastic_net").alias("method"), "y", "p", "predicted")
    cohort = R.gather(cells, labels) if config.metric in R.METRICS else None
    if cohort is not None:
        trees = R.run_trees(cells, cohort, config, grids, {"random_forest": FOREST_TREES, "boosted_trees": BOOSTING_ROUNDS})
    else:
        trees = _distributed_trees(cells, labels, config, grids)
    return binary_metrics(cut(net.unionByName(trees.select("method", "y", "p", (F.col("p") >= 0.5).alias("predicted")))), ["method"])


def _distributed_trees(cells: DataFrame, labels: DataFrame, config: Config, grids: dict[str, list[dict]]) -> DataFrame:
    assigned = cut(assign_folds(labels, config.outer_folds, config.repeats, config.seed))
    out = []
    for algorithm, grid in grids.items():
        for repeat in range(1, config.repeats + 1):
            for fold in range(1, config.outer_folds + 1):
                here = assigned.where(F.col("repeat") == repeat)
                train, test = cut(here.where(F.col("fold") != fold).select("sample_id", "y", "group")), here.where(F.col("fold") == fold)
                seed = R.seed_of(config.seed, "trees", repeat, fold)
                best = grid[0] if len(grid) == 1 else _tune_tree(cells, train, config, algorithm, grid, seed)
                p = prepare_fold(cells, _rows(train), _rows(test), config.features, config.balanced)
                model = _tree(algorithm, best, R.seed_of(seed, "fit")).fit(p.train)
                out.append(cut(model.transform(p.test).select(
                    F.lit(algorithm).alias("method"), F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))))
                _release([p])
    return union_all(out)


def _tune_tree(cells: DataFrame, train: DataFrame, config: Config, algorithm: str, grid: list[dict], seed: int) -> dict:
    folds = cut(assign_folds(train, config.inner_folds, 1, seed))
    tasks, prepared = [], []
    for fold in range(1, config.inner_folds + 1):
        p = prepare_fold(cells, _rows(folds.where(F.col("fold") != fold)), _rows(folds.where(F.col("fold") == fold)), config.features, config.balanced)
        prepared.append(p)
        for index, parameters in enumerate(grid):
            def job(p=p, index=index, parameters=parameters, fold=fold):
                model = _tree(algorithm, parameters, R.seed_of(seed, "tune", index, fold)).fit(p.train)
                return model.transform(p.test).select(F.lit(index).alias("candidate"), F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))

            tasks.append(job)
    scored = cut(union_all(_pool(config.threads, tasks)))
    _release(prepared)
    values = _score_by(scored, ["candidate"], config.metric)
    return grid[max(range(len(grid)), key=lambda i: (round(values[i], 12), -i))]


# ---- several classes


def _coded(labels: DataFrame) -> tuple[list[str], DataFrame]:
    """(class names in order, labels with y = 0, 1, ...)."""
    classes = [r[0] for r in labels.select(F.col("y").cast("string")).distinct().orderBy("y").collect()]  # 3 to 20
    return classes, labels.withColumn("y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y").cast("string")) - 1).cast("int"))


def _multiclass(config: Config) -> Config:
    return config if config.metric in ("macro_roc_auc", "macro_f1", "balanced_accuracy") else replace(config, metric="macro_roc_auc")


def _long_rows(fits: DataFrame, classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    rows = fits.select("permutation", "repeat", "fold", F.explode("predictions").alias("x")).select("permutation", "repeat", "fold", "x.sample_id", F.get(names, F.col("x.y")).alias("observed"), F.posexplode("x.chance").alias("_i", "probability"))
    return rows.select("permutation", "repeat", "fold", "sample_id", F.lit(None).cast("string").alias("group"), "observed", F.get(names, F.col("_i")).alias("class"), "probability")


def nested_cv_multiclass(cells: DataFrame, labels: DataFrame, config: Config, fold_labels: DataFrame | None = None) -> tuple[DataFrame, list[Fold]]:
    """(long out-of-fold class probabilities, tuned folds); y holds class names."""
    classes, coded = _coded(labels)
    cohort = R.gather(cells, coded) if fold_labels is None else None
    if cohort is not None:
        fits = cut(R.run(cells, cohort, _multiclass(config), len(classes)))
        long = _long_rows(fits, classes).drop("permutation", "group").join(labels.select("sample_id", F.col("group").cast("string").alias("group")), "sample_id")
        records = [Fold(r["repeat"], r["fold"], *config.candidates[r["candidate"]], 0.5) for r in fits.select("repeat", "fold", "candidate").orderBy("repeat", "fold").collect()]
        return long.select("repeat", "fold", "sample_id", "group", "observed", "class", "probability"), records
    placed = assign_folds(_coded(fold_labels)[1] if fold_labels is not None else coded, config.outer_folds, config.repeats, config.seed)
    assigned = cut(placed.select("repeat", "sample_id", "fold").join(coded.select("sample_id", "y", "group"), "sample_id"))
    if (names := N.fits_here(cells, coded, config.features, len(classes))) is not None:
        packed, groups = _packed_folds(cells, coded, assigned, config, names)
        best, _, scale = _tuned(packed, len(groups), config, classes, True)
        models = [N.Model(g, 0, j, *config.candidates[j]) for g, j in best.items()]
        fits = N.fit(packed, models, {(m.group, 0): scale[m.group, 0] for m in models}, len(classes))
        repeat, fold = F.floor(F.col("grp") / config.outer_folds) + 1, F.col("grp") % config.outer_folds + 1
        long = _class_rows(N.score(packed, fits), classes, "grp").join(labels.select("sample_id", F.col("group").cast("string").alias("group")), "sample_id")
        return cut(long.select(repeat.cast("int").alias("repeat"), fold.cast("int").alias("fold"), "sample_id", "group", "observed", "class", "probability")), [
            Fold(*groups[g], *config.candidates[j], 0.5) for g, j in best.items()]
    out, records = [], []
    for repeat in range(1, config.repeats + 1):
        for fold in range(1, config.outer_folds + 1):
            here = assigned.where(F.col("repeat") == repeat)
            train, test = cut(here.where(F.col("fold") != fold).select("sample_id", "y", "group")), here.where(F.col("fold") == fold)
            c, ratio = _tune_multiclass(cells, train, config, classes, R.seed_of(config.seed, "inner", repeat, fold))
            p = prepare_fold(cells, _rows(train), _rows(test), config.features, config.balanced)
            model = fit_enet(p, c, ratio, "multinomial")
            out.append(cut(_long_probabilities(model, p.test, classes).select(F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "*")))
            records.append(Fold(repeat, fold, c, ratio, 0.5))
            _release([p])
    return union_all(out), records


def _long_probabilities(model, rows: DataFrame, classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    scored = model.transform(rows).select("sample_id", "group", F.get(names, F.col("label").cast("int")).alias("observed"), F.posexplode(vector_to_array("probability")).alias("_i", "probability"))
    return scored.select("sample_id", "group", "observed", F.get(names, F.col("_i")).alias("class"), "probability")


def _tune_multiclass(cells: DataFrame, labels: DataFrame, config: Config, classes: list[str], seed: int) -> tuple[float, float]:
    if (names := N.fits_here(cells, labels, config.features, len(classes))) is not None:
        packed = N.pack(cells, labels, _inner_parts(labels.withColumn("grp", F.lit(0)), {0: seed}, config.inner_folds), 1, names)
        return config.candidates[_tuned(packed, 1, config, classes, False)[0][0]]
    folds = cut(assign_folds(labels, config.inner_folds, 1, seed))
    tasks, prepared = [], []
    for fold in range(1, config.inner_folds + 1):
        p = prepare_fold(cells, _rows(folds.where(F.col("fold") != fold)), _rows(folds.where(F.col("fold") == fold)), config.features, config.balanced)
        prepared.append(p)
        for index, (c, ratio) in enumerate(config.candidates):
            def job(p=p, c=c, ratio=ratio, index=index):
                return _long_probabilities(fit_enet(p, c, ratio, "multinomial"), p.test, classes).withColumn("candidate", F.lit(index))

            tasks.append(job)
    scored = cut(union_all(_pool(config.threads, tasks)))
    _release(prepared)
    metric = config.metric if config.metric in ("macro_roc_auc", "macro_f1", "balanced_accuracy") else "macro_roc_auc"
    values = {r["candidate"]: r[metric] for r in multiclass_metrics(scored, ["candidate"]).collect()}
    return config.candidates[_first_best([values[index] for index in range(len(config.candidates))])]


# ---- locked model


@dataclass
class LockedModel:
    """coefficients: feature_id, mean, scale, class, coefficient. model: one row with kind, classes,
    intercepts, calibration, threshold and digests."""

    coefficients: DataFrame
    model: DataFrame


def lock_model(cells: DataFrame, labels: DataFrame, config: Config, negative: str = "negative", positive: str = "positive") -> LockedModel:
    """Tune, calibrate and fit once on the whole cohort."""
    (c, ratio), decisions = tune(cells, labels, config, R.seed_of(config.seed, "inner", 0, 0))
    line = fit_calibrator(decisions) if config.calibrate else None
    threshold = 0.5
    if config.tune_threshold:
        threshold = float(youden(decisions.select("y", _calibrated(F.col("decision"), line).alias("p"))).first()["threshold"])
    p = prepare_fold(cells, _rows(labels), _rows(labels), config.features, config.balanced)
    model = fit_enet(p, c, ratio)
    table = cut(_coefficients(model, p).select("feature_id", "mean", F.col("sd").alias("scale"), F.lit(positive).alias("class"), "coefficient"))
    _release([p])
    # vectors were not centred, so the centred form moves the means into the intercept
    shift = table.agg(F.sum(F.col("mean") / F.col("scale") * F.col("coefficient"))).first()[0] or 0.0
    return _locked(table, [negative, positive], [float(model.intercept + shift)], line, threshold, c, ratio)


def lock_model_multiclass(cells: DataFrame, labels: DataFrame, config: Config) -> LockedModel:
    """Tune and fit several classes once on the whole cohort; y holds class names."""
    classes, coded = _coded(labels)
    coded = cut(coded)
    cohort = R.gather(cells, coded)
    if cohort is not None:
        fit = cut(R.run(cells, cohort, _multiclass(config), len(classes), whole=True))
        one = fit.select("candidate", "intercepts").first()
        table = fit.select(F.explode("coefficients").alias("x")).select("x.feature_id", "x.mean", F.col("x.sd").alias("scale"), F.posexplode("x.values").alias("_i", "coefficient"))
        table = cut(table.select("feature_id", "mean", "scale", F.get(F.array(*[F.lit(c) for c in classes]), F.col("_i")).alias("class"), "coefficient"))
        return _locked(table, classes, list(one["intercepts"]), None, 0.5, *config.candidates[one["candidate"]])
    c, ratio = _tune_multiclass(cells, coded, config, classes, R.seed_of(config.seed, "inner", 0, 0))
    p = prepare_fold(cells, _rows(coded), _rows(coded), config.features, config.balanced)
    model = fit_enet(p, c, ratio, "multinomial")
    matrix = model.coefficientMatrix.toArray()
    rows = [(i, name, float(matrix[k, i])) for k, name in enumerate(classes) for i in range(matrix.shape[1])]
    values = p.selected.sparkSession.createDataFrame(rows, "i int, class string, coefficient double")
    table = cut(p.selected.join(values, "i").select("feature_id", "mean", F.col("sd").alias("scale"), "class", "coefficient"))
    _release([p])
    shifts = {r[0]: r[1] for r in table.groupBy("class").agg(F.sum(F.col("mean") / F.col("scale") * F.col("coefficient"))).collect()}
    intercepts = [float(b + shifts[name]) for name, b in zip(classes, model.interceptVector.toArray())]
    return _locked(table, classes, intercepts, None, 0.5, c, ratio)


def _locked(table: DataFrame, classes: list[str], intercepts: list[float], line, threshold: float, c: float, ratio: float) -> LockedModel:
    spark = table.sparkSession
    row = [(len(classes), classes, intercepts, "none" if line is None else "sigmoid", None if line is None else line[1], None if line is None else line[0], threshold, c, ratio)]
    schema = ("class_count int, classes array<string>, intercepts array<double>, calibration string, calibration_slope double, calibration_intercept double, "
              "threshold double, c double, l1_ratio double")
    one = spark.createDataFrame(row, schema)
    return LockedModel(table, one_row(one, model_digests(table, one)))

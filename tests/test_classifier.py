import numpy as np
import pytest
from pyspark.sql import functions as F

from exprspark.operators import classifier as C
from exprspark.operators import metrics as M
from exprspark.operators import predict as P


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    y = np.arange(40) % 2
    x = rng.normal(size=(6, 40))
    x[0] += 1.5 * y
    x[1] -= 1.2 * y
    cells = [(f"f{i}", f"s{j:02d}", float(x[i, j])) for i in range(6) for j in range(40)]
    labels = [(f"s{j:02d}", int(y[j]), f"g{j // 4}") for j in range(40)]
    return (x, y, spark.createDataFrame(cells, "feature_id string, sample_id string, value double").cache(),
            spark.createDataFrame(labels, "sample_id string, y int, group string").cache())


def test_folds_keep_units_together_and_cover_everyone(cohort):
    _, _, _, labels = cohort
    assigned = C.assign_folds(labels, 3, 2, 9)
    assert C.check_leakage(assigned).count() == 0
    assert assigned.groupBy("repeat").count().collect() == [(1, 40), (2, 40)] or {r[1] for r in assigned.groupBy("repeat").count().collect()} == {40}
    plan = C.fold_plan(assigned).toPandas()
    assert (plan["training_sample_count"] + plan["test_sample_count"] == 40).all() and (plan["group_overlap_count"] == 0).all()
    again = C.assign_folds(labels.repartition(3), 3, 2, 9)
    assert again.exceptAll(assigned).count() == 0


def test_permuted_labels_keep_their_counts(cohort):
    _, _, _, labels = cohort
    shuffled = C.permute_labels(labels, 5, 1)
    assert shuffled.groupBy("group").agg(F.sum("y").alias("s")).exceptAll(labels.groupBy("group").agg(F.sum("y").alias("s"))).count() == 0


def test_elastic_net_meets_the_optimality_conditions(cohort):
    x, y, cells, labels = cohort
    rows = C._rows(labels)
    prepared = C.prepare_fold(cells, rows, rows, 6)
    c, ratio = 0.5, 0.5
    model = C.fit_enet(prepared, c, ratio)
    beta = C._coefficients(model, prepared).toPandas().set_index("feature_id")["coefficient"].sort_index().to_numpy()
    z = ((x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)).T
    shift = float((x.mean(1) / x.std(1) * beta).sum())
    p = 1 / (1 + np.exp(-(z @ beta + model.intercept + shift)))
    gradient = c * z.T @ (p - y) + (1 - ratio) * beta
    assert abs((p - y).sum()) < 1e-3
    for g, b in zip(gradient, beta):
        if abs(b) > 1e-9:
            assert g + ratio * np.sign(b) == pytest.approx(0, abs=5e-3)
        else:
            assert abs(g) <= ratio + 5e-3
    assert beta[0] > 0 > beta[1]


def test_validation_has_one_prediction_per_sample_and_finds_the_signal(cohort):
    _, _, cells, labels = cohort
    config = C.Config(features=4, outer_folds=2, inner_folds=2, repeats=1, seed=3, candidates=[(0.5, 0.5)])
    result = C.nested_cv(cells, labels, config)
    assert C.check_oof(result.predictions, labels, 1).count() == 0
    assert M.binary_metrics(result.predictions).first()["roc_auc"] > 0.7


def test_locked_prediction_by_hand_and_its_guards(spark):
    cells = spark.createDataFrame([("a", "s1", 2.0), ("b", "s1", 1.0), ("a", "s2", 4.0)], "feature_id string, sample_id string, value double")
    coef = spark.createDataFrame([("a", 1.0, 2.0, "pos", 1.5), ("b", 0.5, 1.0, "pos", -1.0)], "feature_id string, mean double, scale double, class string, coefficient double")
    model = spark.createDataFrame([(2, ["neg", "pos"], [0.2], "none", None, None, 0.5)],
                                  "class_count int, classes array<string>, intercepts array<double>, calibration string, calibration_slope double, calibration_intercept double, threshold double")
    got = {r["sample_id"]: r["positive_probability"] for r in P.predict_locked(cells, coef, model).collect()}
    assert got["s1"] == pytest.approx(1 / (1 + np.exp(-(0.5 * 1.5 - 0.5 + 0.2))))
    assert got["s2"] == pytest.approx(1 / (1 + np.exp(-(1.5 * 1.5 + 0.5 + 0.2))))
    with pytest.raises(ValueError, match="missing"):
        P.predict_locked(cells.where("feature_id = 'a'"), coef, model)
    with pytest.raises(ValueError, match="positive"):
        P.predict_locked(cells, coef.withColumn("scale", F.lit(0.0)), model)
    sealed = model.crossJoin(P.model_digests(coef, model))
    P.check_model(coef, sealed)
    with pytest.raises(ValueError, match="integrity"):
        P.check_model(coef.withColumn("coefficient", F.col("coefficient") + 1), sealed)

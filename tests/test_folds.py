"""Fits inside tasks against the distributed ones: draws, optima, whole validations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprspark.operators import classifier as C
from exprspark.operators import folds as R
from exprspark.operators import metrics as M


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    y = np.arange(48) % 2
    x = np.round(rng.normal(size=(7, 48)), 4)
    x[0] += 1.5 * y
    x[1] -= 1.2 * y
    x[6, ::2] = 0
    cells = [(f"f{i}", f"s{j:02d}", float(x[i, j])) for i in range(7) for j in range(48) if x[i, j]]
    labels = [(f"s{j:02d}", int(y[j]), f"g{j // 4}") for j in range(48)]
    return (spark.createDataFrame(cells, "feature_id string, sample_id string, value double").cache(),
            spark.createDataFrame(labels, "sample_id string, y int, group string").cache())


def test_draws_equal_those_of_spark(spark, cohort):
    cells, labels = cohort
    held = R.gather(cells, labels)
    for repeat in (1, 2):
        want = {r.sample_id: r.fold for r in C.assign_folds(labels, 5, 2, 9).where(F.col("repeat") == repeat).collect()}
        assert dict(zip(held.samples, R.fold_numbers(held.units, held.y, 5, 9, repeat))) == want
    apart = labels.withColumn("group", F.lit(None).cast("string"))
    pure = labels.withColumn("group", F.concat(F.lit("u"), F.col("y"), F.substring("group", 2, 3)))
    for frame in (labels, apart, pure):
        held = R.gather(cells, frame)
        want = {r.sample_id: r.y for r in C.permute_labels(frame, 7, 3).collect()}
        assert dict(zip(held.samples, R.permuted(held, 7, 3).tolist())) == want


@pytest.mark.parametrize("classes", [2, 4])
def test_optimality_conditions(classes):
    rng = np.random.default_rng(classes)
    problems = []
    for n in (60, 47):
        y = np.arange(n) % classes
        x = rng.normal(size=(n, 9))
        x[:, 0] += y
        problems.append(R.Problem((x - x.mean(0)) / x.std(0), y, rng.uniform(0.5, 2, n)))
    b, b0 = R.elastic_nets(problems, C.CANDIDATES, classes)
    for i, q in enumerate(problems):
        for j, (c, ratio) in enumerate(C.CANDIDATES):
            chance = R._probabilities(q.x @ b[i, j].T + b0[i, j])
            target = (q.y[:, None] == (np.array([1]) if classes == 2 else np.arange(classes))[None]).astype(float)
            gap = q.weights[:, None] * (chance - target)
            slope = c * gap.T @ q.x + (1 - ratio) * b[i, j]
            zero = np.abs(b[i, j]) < 1e-10
            assert c * np.abs(gap.sum(0)).max() < 1e-3
            assert (np.abs(slope[zero]) <= ratio + 1e-3).all() and np.abs(slope + ratio * np.sign(b[i, j]))[~zero].max(initial=0) < 1e-3


def test_separable_and_constant_data():
    y = np.arange(20) % 2
    x = np.column_stack([y * 2.0 - 1, np.zeros(20)])
    b, _ = R.elastic_nets([R.Problem(x, y, np.ones(20))], C.CANDIDATES, 2)
    assert np.isfinite(b).all() and (b[0, :, 0, 1] == 0).all() and (b[0, :, 0, 0] >= 0).all()


def test_metrics_equal_the_tables(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 90), np.round(rng.random(90), 1)
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    want = M.binary_metrics(frame.withColumn("predicted", F.col("p") >= 0.5)).first()
    both = np.column_stack([1 - p, p])
    for metric in ("roc_auc", "pr_auc", "balanced_accuracy"):
        assert R.score(metric, y, both) == pytest.approx(want[metric])
    assert R.best_threshold(y, p) == M.youden(frame).first()["threshold"]
    line = C.fit_calibrator(frame.select("y", F.col("p").alias("decision")))
    assert R.logistic_line(p, y) == pytest.approx(line, abs=1e-6)


def test_validation_equals_the_distributed_one(cohort, monkeypatch):
    cells, labels = cohort
    config = C.Config(features=5, outer_folds=2, inner_folds=2, repeats=1, seed=3, candidates=[(0.5, 0.5), (0.05, 0.0)])
    near = C.nested_cv(cells, labels, config)
    monkeypatch.setattr(R, "MATRIX_CELLS", 1)
    far = C.nested_cv(cells, labels, config)
    assert [(f.c, f.ratio) for f in near.folds] == [(f.c, f.ratio) for f in far.folds]
    a, b = ({r.sample_id: r for r in v.predictions.collect()} for v in (near, far))
    assert set(a) == set(b)
    for k in a:
        assert (a[k].fold, a[k].y, a[k].group) == (b[k].fold, b[k].y, b[k].group) and a[k].p == pytest.approx(b[k].p, abs=5e-3)
    a, b = ({(r.fold, r.feature_id): r.coefficient for r in v.coefficients.collect()} for v in (near, far))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=5e-3) for k in a)


def test_permutations_find_the_signal_and_none_in_noise(cohort):
    cells, labels = cohort
    config = C.Config(features=7, outer_folds=3, inner_folds=2, repeats=1, seed=3)
    got = C.permutation_control(cells, labels, config, 19).toPandas()
    assert len(got) == 19 and got["empirical_p_value"].nunique() == 1 and got["empirical_p_value"][0] == pytest.approx(0.05)
    assert 0.3 < got["roc_auc"].mean() < 0.7 and got["observed_roc_auc"][0] > 0.8
    noise = cells.where("feature_id not in ('f0', 'f1')")
    p = C.permutation_control(noise, labels, config, 19).first()
    assert p.empirical_p_value > 0.05 and p.empirical_p_value == pytest.approx((1 + sum(r.roc_auc >= p.observed_roc_auc for r in C.permutation_control(noise, labels, config, 19).collect())) / 20)


def test_several_classes(spark):
    rng = np.random.default_rng(5)
    y = np.arange(60) % 3
    x = rng.normal(size=(5, 60))
    x[0] += 2 * y
    x[1] += 2 * (y == 1)
    cells = spark.createDataFrame([(f"f{i}", f"s{j:02d}", float(x[i, j])) for i in range(5) for j in range(60)], "feature_id string, sample_id string, value double")
    labels = spark.createDataFrame([(f"s{j:02d}", "abc"[y[j]], None) for j in range(60)], "sample_id string, y string, group string")
    config = C.Config(features=5, outer_folds=3, inner_folds=2, repeats=1, seed=2, metric="macro_roc_auc")
    long, records = C.nested_cv_multiclass(cells, labels, config)
    assert len(records) == 3 and long.count() == 180 and M.multiclass_metrics(long).first()["macro_roc_auc"] > 0.8
    assert long.groupBy("sample_id").agg(F.sum("probability").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    got = C.permutation_control_multiclass(cells, labels, config, 9).toPandas()
    assert got["empirical_p_value"][0] == pytest.approx(0.1) and got["macro_roc_auc"].max() < got["observed_macro_roc_auc"][0]
    locked = C.lock_model_multiclass(cells, labels, config)
    assert locked.coefficients.count() == 15 and list(locked.model.first()["classes"]) == ["a", "b", "c"]

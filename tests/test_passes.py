"""Fits in passes over the rows, for cohorts too large to be broadcast, against fits inside tasks and one after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprspark.operators import classifier as C
from exprspark.operators import folds as R
from exprspark.operators import metrics as M
from exprspark.operators import passes as N


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(8)
    x, y = np.round(rng.normal(size=(6, 90)), 4), np.arange(90) % 3
    x[0] += 1.5 * (y == 1)
    x[1] -= 1.2 * (y == 2)
    x[5, ::2] = 0
    cells = spark.createDataFrame([(f"f{i}", f"s{j:02d}", float(x[i, j])) for i in range(6) for j in range(90) if x[i, j]], "feature_id string, sample_id string, value double")
    two = spark.createDataFrame([(f"s{j:02d}", int(y[j] > 0), f"g{j // 3}") for j in range(90)], "sample_id string, y int, group string")
    three = spark.createDataFrame([(f"s{j:02d}", "abc"[y[j]], None) for j in range(90)], "sample_id string, y string, group string")
    return cells.cache(), two.cache(), three.cache()


@pytest.fixture
def large(monkeypatch):
    """Every cohort counts as too large for a broadcast, and fits one after another are not allowed."""
    monkeypatch.setattr(R, "MATRIX_CELLS", 1)

    def refuse(*_, **__):
        raise AssertionError("one fit after another")

    monkeypatch.setattr(C, "fit_enet", refuse)


def test_two_classes(cohort, request):
    cells, labels, _ = cohort
    config = C.Config(features=4, outer_folds=3, inner_folds=2, repeats=2, seed=5)
    near = C.nested_cv(cells, labels, config)
    tuned, held = C.tune(cells, labels, config, 11)
    request.getfixturevalue("large")
    far = C.nested_cv(cells, labels, config)
    assert [(f.repeat, f.fold, f.c, f.ratio) for f in near.folds] == [(f.repeat, f.fold, f.c, f.ratio) for f in far.folds]
    assert [f.threshold for f in near.folds] == pytest.approx([f.threshold for f in far.folds], abs=1e-4)
    a, b = ({(r.repeat, r.sample_id): r for r in v.predictions.collect()} for v in (near, far))
    assert set(a) == set(b) and len(a) == 180
    assert all((a[k].fold, a[k].y, a[k].group) == (b[k].fold, b[k].y, b[k].group) and a[k].p == pytest.approx(b[k].p, abs=1e-4) for k in a)
    a, b = ({(r.repeat, r.fold, r.feature_id): r.coefficient for r in v.coefficients.collect()} for v in (near, far))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-4) for k in a)
    again, rows = C.tune(cells, labels, config, 11)
    a, b = ({r.sample_id: r.decision for r in v.collect()} for v in (held, rows))
    assert again == tuned and set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-4) for k in a)


def test_several_classes(cohort, request):
    cells, _, labels = cohort
    config = C.Config(features=6, outer_folds=2, inner_folds=2, repeats=1, seed=2)
    near, folds = C.nested_cv_multiclass(cells, labels, config)
    request.getfixturevalue("large")
    far, again = C.nested_cv_multiclass(cells, labels, config)
    assert [(f.c, f.ratio) for f in folds] == [(f.c, f.ratio) for f in again]
    a, b = ({(r.sample_id, r["class"]): r for r in v.collect()} for v in (near, far))
    assert set(a) == set(b) and all((a[k].fold, a[k].observed) == (b[k].fold, b[k].observed) and a[k].probability == pytest.approx(b[k].probability, abs=1e-3) for k in a)


def test_learning_curve(cohort, monkeypatch):
    cells, labels, _ = cohort
    config = C.Config(features=6, outer_folds=2, inner_folds=2, repeats=1, seed=2, candidates=[(0.5, 0.5)])
    validation = C.nested_cv(cells, labels, config)
    got = {tuple(r)[:3]: r.roc_auc for r in C.learning_curve(cells, labels, validation, config).collect()}
    monkeypatch.setattr(N, "MOST_FEATURES", 1)
    want = {tuple(r)[:3]: r.roc_auc for r in C.learning_curve(cells, labels, validation, config).collect()}
    assert set(got) == set(want) and len(got) == 6 and all(got[k] == pytest.approx(want[k], abs=5e-3) for k in got)


def test_fits_one_after_another_stay_for_wide_cohorts(cohort, monkeypatch):
    cells, labels, _ = cohort
    config = C.Config(features=4, outer_folds=2, inner_folds=2, repeats=1, seed=5, candidates=[(0.5, 0.5), (0.05, 0.0)])
    monkeypatch.setattr(R, "MATRIX_CELLS", 1)
    far = C.nested_cv(cells, labels, config)
    monkeypatch.setattr(N, "MOST_FEATURES", 1)
    wide = C.nested_cv(cells, labels, config)
    a, b = ({r.sample_id: r.p for r in v.predictions.collect()} for v in (far, wide))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=5e-3) for k in a)


def test_lines_of_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=120)
    frame = spark.createDataFrame([(j % 2, float(x[j]), int(rng.random() < 1 / (1 + np.exp(-x[j] * (1 + j % 2)))), 1) for j in range(120)], "grp int, x double, pos bigint, n bigint")
    both = M.logistic_lines(frame, "grp")
    assert all(both[g] == pytest.approx(M.logistic_line(frame.where(F.col("grp") == g)), abs=1e-8) for g in (0, 1))


def test_moves_that_the_softmax_does_not_see():
    """Coordinates alone creep along such moves; a step must reach the least penalty at once."""
    rng = np.random.default_rng(2)
    b = rng.normal(size=(3, 5))
    for ratio in (0.0, 0.5, 1.0):
        def cost(v, ratio=ratio):
            return (ratio * np.abs(v) + (1 - ratio) / 2 * v * v).sum(0)

        got = N._shifted(b, ratio)
        assert np.ptp(got - b, axis=0) == pytest.approx(0, abs=1e-12)
        assert all((cost(got) <= cost(b + t) + 1e-9).all() for t in np.linspace(-3, 3, 601))

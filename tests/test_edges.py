"""Ordinary edge inputs: one class, full sets, one sample, several files, per-study criteria."""

import pytest
from pyspark.sql import functions as F

from exprspark.operators import classifier, enrich, matrix, metrics, score, studies
from exprspark.sources import bundle, tables


def test_one_class_has_no_ranking_metrics(spark):
    pred = spark.createDataFrame([(1, 0.2, False), (1, 0.9, True)], "y int, p double, predicted boolean")
    row = metrics.binary_metrics(pred).first()
    assert row.roc_auc is None and row.pr_auc == pytest.approx(1.0) and row.accuracy == 0.5
    none = metrics.binary_metrics(pred.withColumn("y", F.lit(0))).first()
    assert none.roc_auc is None and none.pr_auc is None
    assert metrics.roc_points(pred).count() == 3 and metrics.precision_recall_points(pred).count() == 3


def test_bootstrap_draws_again_until_both_classes_are_there(spark):
    rows = [(f"s{i}", f"g{i % 3}", int(i % 3 == 0), 0.1 + 0.2 * (i % 4), i % 2 == 0) for i in range(9)]
    pred = spark.createDataFrame(rows, "sample_id string, group string, y int, p double, predicted boolean")
    got = metrics.bootstrap_ci(pred, 20, 3)
    assert got.count() > 0


def test_a_set_of_all_features_scores_zero(spark):
    ranks = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 2), ("c", -2.0, 3)], "feature_id string, score double, position int")
    sets = spark.createDataFrame([("all", f) for f in "abc"] + [("one", "a")], "set_id string, feature_id string")
    scored, _ = enrich.gsea_score(ranks, enrich.eligible_sets(sets, ranks, 1, 10))
    assert {r.set_id: r.enrichment_score for r in scored.collect()} == {"all": 0.0, "one": 1.0}
    cells = spark.createDataFrame([(f, s, float(v)) for s, vs in (("x", (5, 2, 1)), ("y", (1, 4, 2))) for f, v in zip("abc", vs)], "feature_id string, sample_id string, value double")
    assert all(r.score is None for r in score.score_ssgsea(cells, sets.where("set_id = 'all'"), normalize=False).collect())
    assert score.score_gsva(cells, sets, kernel="none").count() == 4


def test_one_sample_has_no_variance(spark):
    cells = spark.createDataFrame([("a", "x", 5.0), ("b", "x", 2.0)], "feature_id string, sample_id string, value double")
    assert [(r.var_samp, r.var_pop) for r in matrix.feature_moments(cells).collect()] == [(None, 0.0)] * 2
    assert matrix.top_variable(cells, 2).count() == 0
    assert all(r.value == 0.0 for r in matrix.scale_features(cells).collect())


def test_folders_of_parts_are_audited_as_one_file(spark, tmp_path):
    root = str(tmp_path / "bundle")
    spark.range(0, 300, 1, 3).selectExpr("cast(id as string) as value").write.text(f"{root}/many")
    spark.range(0, 5, 1, 1).selectExpr("cast(id as string) as value").write.text(f"{root}/one")
    manifest = bundle.file_digests(spark, root, "*.txt")
    assert {r.path for r in manifest.collect()} == {"many", "one"}
    assert {(r.path, r.status) for r in bundle.audit_files(manifest, root, "*.txt").collect()} == {("many", "OK"), ("one", "OK")}
    drifted = manifest.withColumn("sha256", F.when(F.col("path") == "many", "0").otherwise(F.col("sha256")))
    assert {(r.path, r.status) for r in bundle.audit_files(drifted, root, "*.txt").collect()} == {("many", "CHECKSUM_DRIFT"), ("one", "OK")}


def test_lines_of_several_files_are_numbered_on(spark, tmp_path):
    for name, text in (("a.txt", "﻿x\ny\n"), ("b.txt", "﻿z\n")):
        (tmp_path / name).write_text(text)
    got = tables.read_lines(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, "y"), (3, "z")]


def test_criteria_follow_their_study(spark):
    criteria = spark.createDataFrame(
        [("a", "paired_bias", "classifier_score", "between", [-1.0, 1.0]), ("b", "icc", "classifier_score", "gte", [0.5]), ("c", "tost_equivalence", "classifier_score", "gte", [1.0]),
         ("d", "icc", "classifier_score", "between", [0.1, 0.9]), ("e", "repeatability_sd", "classifier_score", "lte", [0.1])], "criterion_id string, metric string, endpoint string, operator string, threshold array<double>")

    def judged(wide, study):
        return {r.criterion_id: r.status for r in studies.evaluate_criteria(studies.study_metrics(wide), criteria, study).collect()}

    bridging = spark.createDataFrame([(0.1, True)], "paired_bias double, equivalent boolean")
    assert judged(bridging, "bridging") == {"a": "NOT_APPLICABLE", "b": "NOT_APPLICABLE", "c": "PASS", "d": "NOT_APPLICABLE", "e": "NOT_APPLICABLE"}
    precision = spark.createDataFrame([(0.7, None)], "icc double, repeatability_sd double")
    assert judged(precision, "precision") == {"a": "NOT_APPLICABLE", "b": "PASS", "c": "NOT_APPLICABLE", "d": "PASS", "e": "INDETERMINATE"}


def test_participants_are_units(spark):
    profile = spark.createDataFrame([("Participant-ID", 3, 0), ("biological_sample", 3, 0), ("sex", 2, 0)], "variable string, unique_count long, missing_count long")
    assert [r.variable for r in classifier.hidden_units(profile, 9).collect()] == ["Participant-ID"]


def test_levels_without_a_reference_count_but_make_no_pair(spark):
    from exprspark.operators import studies

    rows = spark.createDataFrame(
        [("a", 5.0, 0.8, "high", False), ("a", 1.0, 0.6, "low", True), ("b", 1.0, 0.9, "high", False), ("c", 5.0, 0.4, "low", False), ("c", 1.0, 0.5, "low", False)],
        "biological_sample_id string, level double, score double, call string, qc_failure boolean")
    low, top = studies.level_metrics(rows, 5.0).orderBy("level").collect()
    assert (low.measurement_count, low.unpaired_count, low.threshold_crossing_count) == (3, 1, 1)
    assert abs(low.mean_score - 2 / 3) < 1e-12 and abs(low.mean_score_difference + 0.05) < 1e-12 and low.call_agreement_to_reference == 0.5
    assert (top.measurement_count, top.unpaired_count, top.mean_score_difference) == (2, 0, 0.0)

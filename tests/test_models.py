"""Linear and count models, enrichment and composition on planted effects and against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprspark.operators import counts, decon, design, enrich, factorial, linear, qc


def cells_of(spark, x, samples=None):
    rows = [(f"f{i:03d}", f"s{j:02d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] != 0]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double").cache()


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(f"s{j:02d}", "treated" if j % 2 else "control", f"d{j // 2}", float(j * j)) for j in range(12)]
    return spark.createDataFrame(rows, "sample_id string, arm string, donor string, age double")


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    base = rng.gamma(3, 60, 60)
    effect = np.zeros(60)
    effect[:8], effect[8:16] = 2.0, -2.0
    arm = np.arange(12) % 2
    mu = base[:, None] * np.exp2(effect[:, None] * (arm[None, :] - 0.5))
    y = rng.poisson(mu * rng.gamma(12, 1 / 12, mu.shape))
    return y, cells_of(spark, y), effect


def test_lm_fit_equals_least_squares(spark, meta):
    rng = np.random.default_rng(2)
    x = rng.normal(1000, 1, (5, 12))
    x[4, 3] = 0.0
    enc = design.encode(meta, design.Design(["donor", "arm"], references={"arm": "control"}))
    weights = design.contrast_weights(enc, "arm", "treated", "control")
    fit, df = linear.lm_fit(cells_of(spark, x), enc, weights)
    got = fit.toPandas().set_index("feature_id").sort_index()
    m = np.array([list(r["x"]) for r in enc.rows.orderBy("sample_id").collect()])
    beta, *_ = np.linalg.lstsq(m, x.T, rcond=None)
    np.testing.assert_allclose(got["effect"], weights @ beta, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(got["sigma2"], ((x.T - m @ beta) ** 2).sum(0) / df, rtol=1e-5)
    moderated = linear.ebayes(fit, df).toPandas()
    assert moderated["p_value"].between(0, 1).all()


def test_rank_deficient_designs_are_refused(spark, meta):
    twice = meta.withColumn("copy", F.col("arm"))
    assert design.design_rank(twice, design.Design(["arm", "copy"])) == (2, 3)
    found = design.validate_design(twice, design.Design(["arm", "copy"]), "arm", "treated", "control").toPandas()
    assert "DESIGN.RANK_DEFICIENT" in set(found["code"])
    with pytest.raises(ValueError):
        enc = design.encode(twice, design.Design(["arm", "copy"]))
        linear.lm_fit(cells_of(spark, np.ones((2, 12))), enc, np.array([0.0, 1.0, 0.0]))


def recovered(table, effect):
    table = table.toPandas().set_index("feature_id")["effect"].sort_index().to_numpy()
    assert (table[:8] > 1).all() and (table[8:16] < -1).all()
    assert np.abs(table[16:]).max() < 1.5
    return table


def test_count_models_recover_planted_effects(spark, meta, planted):
    y, cells, effect = planted
    enc = design.encode(meta, design.Design(["arm"]))
    weights = design.contrast_weights(enc, "arm", "treated", "control")
    wald = counts.nb_wald(cells, enc, qc.size_factors(cells), weights)
    recovered(wald, effect)
    p = wald.toPandas().set_index("feature_id")["p_value"].sort_index().to_numpy()
    assert p[:16].max() < 0.01 and np.median(p[16:]) > 0.1
    sizes = qc.tmm_factors(cells).select("sample_id", (F.col("library_size") * F.col("norm_factor")).alias("size"))
    qlf = counts.nb_qlf(cells, enc, sizes, weights)
    recovered(qlf, effect)
    weighted = linear.voom(cells, sizes, enc, weights)
    recovered(weighted, effect)


def test_enrichment_finds_the_planted_set(spark, planted):
    rows = [(f"f{i:03d}", 1.0 if i < 8 else -0.1, 1e-6 * (i + 1) if i < 8 else 0.2 + 0.01 * i, i < 8) for i in range(60)]
    de = spark.createDataFrame(rows, "feature_id string, log2_fold_change double, p_value double, significant boolean")
    sets = spark.createDataFrame([("up", f"f{i:03d}") for i in range(8)] + [("other", f"f{i:03d}") for i in range(9, 60, 6)], "set_id string, feature_id string")
    ranks = enrich.rank_features(de)
    members = enrich.eligible_sets(sets, ranks, 2, 50)
    scored, edge = enrich.gsea_score(ranks, members)
    assert scored.where("set_id = 'up'").first()["enrichment_score"] == pytest.approx(1.0)
    assert edge.where("set_id = 'up'").count() == 8
    p = {r["set_id"]: r["p_value"] for r in enrich.gsea_permute(ranks, members, 40, 1).collect()}
    assert p["up"] < 0.1 < p["other"] + 0.1 and p["up"] <= p["other"]
    table, overlap = enrich.ora(de, sets, 2, 50)
    best = enrich.finish_enrichment(table, "odds_ratio").orderBy("rank").first()
    assert best["set_id"] == "up" and best["overlap_size"] == 8 and best["significant"]
    assert overlap.count() == 8


def test_fractions_are_bounded_and_exact_on_mixtures(spark):
    rng = np.random.default_rng(4)
    signature = rng.gamma(2, 3, (30, 3))
    truth = np.array([[0.5, 0.3, 0.2], [0.6, 0.0, 0.1], [0.0, 1.0, 0.0]])
    mixed = signature @ truth.T
    sig = spark.createDataFrame([(f"f{i:03d}", f"c{k}", float(signature[i, k])) for i in range(30) for k in range(3)], "gene string, cell_type_id string, value double")
    got = decon.decon_fractions(cells_of(spark, mixed), sig).toPandas().pivot(index="sample_id", columns="cell_type_id", values="value")
    np.testing.assert_allclose(got[["c0", "c1", "c2"]].to_numpy(), truth, atol=1e-6)
    np.testing.assert_allclose(got["other"], 1 - truth.sum(1), atol=1e-6)
    double = decon.decon_fractions(cells_of(spark, 2 * mixed), sig).where("cell_type_id <> 'other'").groupBy("sample_id").agg(F.sum("value").alias("s")).toPandas()
    assert (double["s"] <= 1 + 1e-9).all()


def test_absorbed_blocks_equal_the_full_model(spark):
    rng = np.random.default_rng(6)
    rows = [(f"m{i:02d}", f"b{i % 5}", "hi" if (i // 5) % 2 else "lo", f"t{(i // 10) % 2}", f"r{(i * 7) % 3}", float(rng.normal())) for i in range(40)]
    df = spark.createDataFrame(rows, "measurement_id string, biological_sample_id string, dose string, time string, run string, y double")
    terms, variance, _ = factorial.multifactor_fit(df, ["dose", "time"], "y")
    got = terms.toPandas().set_index("term")

    def dummies(values):
        return {v: np.array([float(x == v) for x in values]) for v in sorted(set(values))[1:]}

    columns = {"intercept": np.ones(40)}
    for position, name in ((2, "dose"), (3, "time"), (4, "run"), (1, "biological_sample_id")):
        columns.update({f"{name}[{k}]": c for k, c in dummies([r[position] for r in rows]).items()})
    x, y = np.column_stack(list(columns.values())), np.array([r[5] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    cov = np.linalg.inv(x.T @ x) * (residual @ residual) / (40 - x.shape[1])
    for i, name in enumerate(columns):
        assert got.loc[name, "estimate"] == pytest.approx(beta[i], abs=1e-9)
        assert got.loc[name, "standard_error"] == pytest.approx(np.sqrt(cov[i, i]), rel=1e-9)
    assert variance.first()["model_residual"] == pytest.approx(residual.var(ddof=1))

import pytest
from pyspark.sql import functions as F

from exprspark.operators import score

MATRIX = {"gene_1": (1, 2, 4), "gene_2": (4, 2, 1), "gene_3": (2, 2, 2), "gene_4": (0, 3, 6)}


@pytest.fixture(scope="module")
def cells(spark):
    # the zero of gene_4 is an absent cell
    rows = [(g, f"sample_{i + 1}", float(v)) for g, values in MATRIX.items() for i, v in enumerate(values) if v]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double")


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame([("set-1", "gene_1", 2.0), ("set-1", "gene_2", -1.0), ("set-1", "gene_3", 0.5)], "set_id string, feature_id string, weight double")


def scores(df):
    return [r["score"] for r in df.orderBy("sample_id").collect()]


@pytest.mark.parametrize("method, expected", [
    (score.score_mean, [7 / 3, 2.0, 7 / 3]), (score.score_weighted, [-1.0, 3.0, 8.0]), (score.score_rank, [0.75, 0.5, 0.5])])
def test_published_scores(cells, members, method, expected):
    assert scores(method(cells, members)) == pytest.approx(expected)
    shuffled = cells.repartition(3, "value")
    assert scores(method(shuffled, members)) == pytest.approx(expected)


def test_mean_z_leaves_out_constant_features(cells, members):
    import numpy as np

    x = np.array([[1.0, 2, 4], [4, 2, 1]])
    want = ((x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)).mean(0)
    assert scores(score.score_mean_z(cells, members)) == pytest.approx(list(want))
    used = {r["feature_id"]: r["used"] for r in score.variable_members(cells, members).collect()}
    assert used == {"gene_1": True, "gene_2": True, "gene_3": False}


def test_set_filter_does_not_change_ranks(cells, members):
    """Ranks use every feature: adding one that no set holds moves them."""
    extra = cells.unionByName(cells.where("feature_id = 'gene_1'").withColumn("feature_id", F.lit("gene_9")).withColumn("value", F.lit(0.5)))
    assert scores(score.score_rank(extra, members)) != pytest.approx([0.75, 0.5, 0.5])


def test_kernel_shares_equal_the_double_sum_without_its_work(monkeypatch):
    """Same shares as the mean over all pairs, from a number of normal tails that does not grow with the values."""
    import numpy as np

    from exprspark.functions.tails import normal_cdf

    asked = []
    monkeypatch.setattr(score, "normal_cdf", lambda x: asked.append(np.size(x)) or normal_cdf(x))
    r = np.random.default_rng(1)
    for values in (r.normal(size=600), np.r_[r.normal(size=300), 1e4, -300.0], np.round(r.gamma(0.3, size=400), 1), np.zeros(5), np.array([1.0, 2.0])):
        h = max(values.std(ddof=1) / 4, 1e-12)
        want = [normal_cdf((x - values) / h).mean() for x in values]
        assert np.abs(score.kernel_shares(values, h) - want).max() < 1e-13
    asked.clear()
    score.kernel_shares(r.normal(size=20_000), 0.25)
    assert sum(asked) < 100


def test_gaussian_places_count_absent_cells_as_zeros(spark, cells):
    import numpy as np

    from exprspark.functions.tails import normal_cdf

    got = {(x["feature_id"], x["sample_id"]): x["density"] for x in score.feature_cdf(cells).collect()}
    for gene, row in MATRIX.items():
        row = np.array(row, dtype=float)
        h = max(row.std(ddof=1) / 4, 1e-12)
        for i, value in enumerate(row):
            assert got[gene, f"sample_{i + 1}"] == pytest.approx(normal_cdf((value - row) / h).mean(), abs=1e-13)


def test_association_computes_its_scores_once(spark, tmp_path):
    """The adjusted p-values are joined back on the p-values of one evaluation, not of several."""
    from exprspark.operators.associate import associate

    log = str(tmp_path / "evaluations")

    def seen(batches):
        for batch in batches:
            with open(log, "a") as out:
                out.write("x\n" * bool(len(batch)))
            yield batch

    rows = [(s, f"m{i}", float((i * k) % 7)) for k, s in ((3, "a"), (5, "b")) for i in range(12)]
    scored = spark.createDataFrame(rows, "set_id string, sample_id string, score double").coalesce(1).mapInPandas(seen, "set_id string, sample_id string, score double")
    meta = spark.createDataFrame([(f"m{i}", float(i * i % 11)) for i in range(12)], "sample_id string, dose double")
    assert associate(scored, meta, "dose").where("adjusted_p_value is not null").count() == 2
    assert len(open(log).read().split()) == 1

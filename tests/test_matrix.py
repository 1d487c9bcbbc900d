import numpy as np
import pytest
from pyspark.sql import functions as F

from exprspark.operators import cluster, matrix


def cells_of(spark, x):
    rows = [(f"f{i:03d}", f"s{j:02d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] != 0]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double")


@pytest.fixture(scope="module")
def sparse():
    rng = np.random.default_rng(0)
    x = np.where(rng.uniform(size=(40, 9)) < 0.4, 0.0, rng.normal(5, 2, (40, 9)))
    x[3] = 7.0
    return x


def test_moments_and_products_count_absent_cells_as_zero(spark, sparse):
    cells = cells_of(spark, sparse)
    got = matrix.feature_moments(cells, 9).toPandas().set_index("feature_id").sort_index()
    np.testing.assert_allclose(got["mean"], sparse.mean(1), atol=1e-12)
    np.testing.assert_allclose(got["var_samp"], sparse.var(1, ddof=1), atol=1e-10)
    g = matrix.gram(cells).toPandas()
    want = sparse.T @ sparse
    for _, row in g.iterrows():
        assert row["product"] == pytest.approx(want[int(row["sample_a"][1:]), int(row["sample_b"][1:])])
    assert len(g) == 45


def test_gram_over_several_tiles(spark, sparse, monkeypatch):
    monkeypatch.setattr(matrix, "SAMPLES_PER_TILE", 3)
    monkeypatch.setattr(matrix, "FEATURES_PER_TILE", 11)
    g = matrix.gram(cells_of(spark, sparse)).toPandas()
    want = sparse.T @ sparse
    assert len(g) == 45
    np.testing.assert_allclose(g["product"], [want[int(a[1:]), int(b[1:])] for a, b in zip(g["sample_a"], g["sample_b"])])


@pytest.mark.parametrize("limit, features", [(2000, None), (2000, 6), (2, None)])
def test_components_match_a_decomposition(spark, sparse, limit, features):
    x = sparse[:features].copy()
    x[0] += np.linspace(0, 60, 9)
    x[1] -= np.linspace(0, 30, 9) ** 1.3
    found = matrix.pca(cells_of(spark, x), 2, scale=False, driver_limit=limit)
    centred = (x - x.mean(1, keepdims=True)).T
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    for c in range(2):
        sign = np.sign(vt[c][np.argmax(np.abs(vt[c]))])
        got = found.coordinates.where(F.col("component") == f"PC{c + 1}").toPandas().sort_values("sample_id")["value"]
        np.testing.assert_allclose(got, sign * u[:, c] * s[c], atol=1e-4)
        load = found.loadings.where(F.col("component") == f"PC{c + 1}").toPandas().sort_values("feature_id")["value"]
        np.testing.assert_allclose(load, sign * vt[c], atol=1e-5)
    ratio = found.variance.toPandas()["explained_ratio"]
    np.testing.assert_allclose(ratio, (s ** 2 / (s ** 2).sum())[:2], rtol=1e-5)


def test_components_of_a_flat_spectrum_take_few_passes(spark, monkeypatch):
    """Noise, whose largest values lie close together, with copies of samples and a basis that must restart."""
    x = np.random.default_rng(7).poisson(0.4, (90, 60)).astype(float)
    x = np.hstack([x, np.zeros((90, 2))]) + np.eye(90, 62)
    passes, plain = [], matrix._apply_gram
    monkeypatch.setattr(matrix, "_apply_gram", lambda packed, block: passes.append(block.shape[1]) or plain(packed, block))
    monkeypatch.setattr(matrix, "BASIS_BYTES", 1)
    found = matrix.pca(cells_of(spark, x), 3, scale=False, driver_limit=10)
    assert len(passes) < 25 and sum(passes) > 6 * 8
    u, s, _ = np.linalg.svd((x - x.mean(1, keepdims=True)).T, full_matrices=False)
    got = found.coordinates.groupBy("sample_id").agg(F.sum(F.col("value") * F.col("value")).alias("d")).toPandas().sort_values("sample_id")["d"]
    np.testing.assert_allclose(got, ((u * s)[:, :3] ** 2).sum(1), rtol=1e-6)


def one_at_a_time(points, method):
    clusters = {i: [i] for i in range(len(points))}

    def height(a, b):
        pa, pb = points[clusters[a]], points[clusters[b]]
        d = np.linalg.norm(pa[:, None] - pb[None, :], axis=2)
        if method == "ward":
            na, nb = len(pa), len(pb)
            return np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(pa.mean(0) - pb.mean(0))
        return d.mean() if method == "average" else d.max()

    heights = []
    while len(clusters) > 1:
        keys = sorted(clusters)
        h, a, b = min((height(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1:])
        heights.append(h)
        clusters[a] = clusters[a] + clusters.pop(b)
    return sorted(heights)


@pytest.mark.parametrize("method", ["average", "ward"])
def test_rounds_give_the_tree_of_single_merges(spark, method):
    points = np.random.default_rng(5).normal(size=(10, 2))
    pairs = [(f"s{i:02d}", f"s{j:02d}", float(np.linalg.norm(points[i] - points[j]))) for i in range(10) for j in range(i + 1, 10)]
    merges = cluster.linkage(spark.createDataFrame(pairs, "sample_a string, sample_b string, distance double"), method)
    np.testing.assert_allclose(sorted(merges.toPandas()["distance"]), one_at_a_time(points, method), rtol=1e-9)
    cut = cluster.cut_tree(merges, 3).toPandas()
    assert len(cut) == 10 and cut["cluster"].nunique() == 3


def test_ward_refuses_other_distances(spark):
    with pytest.raises(ValueError):
        cluster.linkage(spark.createDataFrame([], "sample_a string, sample_b string, distance double"), "ward", "correlation")

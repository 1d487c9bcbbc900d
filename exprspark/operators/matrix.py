"""Matrix operators over long cells: variance selection, scaling, products between samples,
principal components, distances. Absent cells are zeros and are never materialised."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import one_row, row_numbers, spread_join
from exprspark.session import cut

SAMPLES_PER_TILE = 256
FEATURES_PER_TILE = 2048
GRAM_ON_DRIVER = 2000
#: Samples whose vectors of a few columns go through the driver; bytes of the basis it keeps, and columns of a pass beyond the wanted ones.
SAMPLES_IN_PASSES, BASIS_BYTES, SPARE_COLUMNS = 400_000, 128_000_000, 5


def shape_of(cells: DataFrame) -> tuple[int, int]:
    """(features, samples)."""
    row = cells.agg(F.count_distinct("feature_id"), F.count_distinct("sample_id")).first()
    return row[0], row[1]


def feature_moments(cells: DataFrame, samples: int | None = None) -> DataFrame:
    """Mean, sample and population variance of each feature over all samples. The second pass runs
    over deviations from the present-cell mean, so large means do not eat the variance. One sample has no
    sample variance (null)."""
    n = F.lit(float(samples if samples is not None else shape_of(cells)[1]))
    per = cells.groupBy("feature_id").agg(
        F.count("value").alias("_k"), F.avg("value").alias("_m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("_v"))
    mean = F.col("_k") * F.col("_m") / n
    # around the overall mean: spread of the present cells plus the zeros' distance to it
    squares = F.col("_k") * F.col("_v") + F.col("_k") * (n - F.col("_k")) / n * F.col("_m") * F.col("_m")
    return per.select("feature_id", mean.alias("mean"), F.try_divide(squares, n - 1).alias("var_samp"), F.try_divide(squares, n).alias("var_pop"))


def top_variable(cells: DataFrame, n: int, samples: int | None = None, keep_constant: bool = False) -> DataFrame:
    """Features of largest variance with their rank; equal variances go by feature id. The
    classifier form may pick constant features."""
    moments = feature_moments(cells, samples)
    pool = moments if keep_constant else moments.where("var_samp > 0")
    best = pool.orderBy(F.desc("var_samp"), "feature_id").limit(n)
    ranked = row_numbers(best.withColumn("_order", -F.col("var_samp")), [], ["_order", "feature_id"], "rank")
    return ranked.drop("_order")


def scale_features(cells: DataFrame, ddof: int = 1, scale: bool = True, samples: int | None = None) -> DataFrame:
    """Centred (and scaled) cells. Only present cells come back; an absent one has the value
    -mean/sd of its feature, which `feature_moments` gives."""
    moments = feature_moments(cells, samples)
    variance = F.col("var_samp") if ddof == 1 else F.col("var_pop")
    sd = F.when(variance > 0, F.sqrt(variance)).otherwise(1.0) if scale else F.lit(1.0)
    side = moments.select("feature_id", F.col("mean").alias("_mean"), sd.alias("_sd"))
    return spread_join(cells, side, ["feature_id"], "sample_id").select(
        "feature_id", "sample_id", ((F.col("value") - F.col("_mean")) / F.col("_sd")).alias("value"))


def gram(cells: DataFrame) -> DataFrame:
    """(sample_a, sample_b, product) with sample_a <= sample_b: sum over features of a*b.

    The matrix is cut into tiles of features x samples by hash. A task holds the cells of one
    feature tile for two sample tiles and multiplies them as arrays, so its size is fixed by the
    tile, not by how full a feature is; the partial products of the feature tiles are then summed.
    """
    features, samples = shape_of(cells)
    feature_tiles, sample_tiles = -(-features // FEATURES_PER_TILE), -(-samples // SAMPLES_PER_TILE)
    tiled = cells.select(
        F.pmod(F.xxhash64("feature_id"), F.lit(max(1, feature_tiles))).cast("int").alias("ft"),
        F.pmod(F.xxhash64("sample_id"), F.lit(max(1, sample_tiles))).cast("int").alias("st"),
        "feature_id", "sample_id", F.col("value").cast("double").alias("value"))
    facing = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(1, sample_tiles) - 1))))
    facing = facing.withColumn("left", F.least("st", "other")).withColumn("right", F.greatest("st", "other"))

    def multiply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, left, right = key
        rows, _ = pd.factorize(frame["feature_id"])
        here = {}
        for tile in {left, right}:
            part = (frame["st"] == tile).to_numpy()
            columns, names = pd.factorize(frame["sample_id"][part], sort=True)
            block = np.zeros((rows.max() + 1, len(names)))
            block[rows[part], columns] = frame["value"].to_numpy()[part]
            here[tile] = (block, np.asarray(names, dtype=object))
        (a, a_names), (b, b_names) = here[left], here[right]
        product = a.T @ b
        if left == right:
            i, j = np.triu_indices(len(a_names))
        else:
            i, j = (x.ravel() for x in np.indices(product.shape))
        first, second = a_names[i], b_names[j]
        swap = first > second
        return pd.DataFrame({
            "sample_a": np.where(swap, second, first), "sample_b": np.where(swap, first, second), "product": product[i, j]})

    partial = facing.select("ft", "left", "right", "st", "feature_id", "sample_id", "value").groupBy("ft", "left", "right").applyInPandas(
        multiply, "sample_a string, sample_b string, product double")
    return partial.groupBy("sample_a", "sample_b").agg(F.sum("product").alias("product"))


def _pair_sums(cells: DataFrame) -> DataFrame:
    """Pairs with their products and each side's sum and sum of squares."""
    per = cells.groupBy("sample_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    a = per.select(F.col("sample_id").alias("sample_a"), F.col("s").alias("sa"), F.col("q").alias("qa"))
    b = per.select(F.col("sample_id").alias("sample_b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    return gram(cells).join(a, "sample_a").join(b, "sample_b")


def sample_correlation(cells: DataFrame, constant_as: float | None = 0.0) -> DataFrame:
    """Pearson correlation over features of every pair of samples, itself included."""
    n = F.lit(float(shape_of(cells)[0]))
    spread_a, spread_b = n * F.col("qa") - F.col("sa") ** 2, n * F.col("qb") - F.col("sb") ** 2
    r = (n * F.col("product") - F.col("sa") * F.col("sb")) / F.sqrt(spread_a * spread_b)
    usable = (spread_a > 1e-12 * n * F.col("qa")) & (spread_b > 1e-12 * n * F.col("qb"))
    clipped = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
    value = F.when(usable, clipped)
    if constant_as is not None:
        value = F.coalesce(value, F.lit(constant_as))
    return _pair_sums(cells).select("sample_a", "sample_b", value.alias("correlation"))


def pairwise_distance(cells: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(sample_a, sample_b, distance) with sample_a < sample_b. Undefined distances are 0."""
    if metric == "correlation":
        pairs = sample_correlation(cells, constant_as=1.0)
        return pairs.where("sample_a < sample_b").select("sample_a", "sample_b", (1 - F.col("correlation")).alias("distance"))
    if metric != "euclidean":
        raise ValueError("Clustering distance must be euclidean or correlation.")
    squared = F.col("qa") + F.col("qb") - 2 * F.col("product")
    return _pair_sums(cells).where("sample_a < sample_b").select(
        "sample_a", "sample_b", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))


@dataclass
class Components:
    coordinates: DataFrame  # sample_id, component, value
    loadings: DataFrame  # feature_id, component, value
    variance: DataFrame  # component, explained_variance, explained_ratio


def _weights(cells: DataFrame, samples: int, scale: bool) -> DataFrame:
    variance = F.when(F.col("var_samp") > 0, F.col("var_samp")).otherwise(1.0) if scale else F.lit(1.0)
    return feature_moments(cells, samples).select("feature_id", F.col("mean").alias("_mean"), F.sqrt(variance).alias("_sd"), "var_samp")


def pca(cells: DataFrame, k: int, scale: bool = True, driver_limit: int = GRAM_ON_DRIVER) -> Components:
    """Principal components of samples over centred (scaled) features. Each component's sign makes
    its largest loading positive.

    The products of the smaller side, features or samples, are summed in one pass and diagonalised
    directly while that side has at most `driver_limit` members. Beyond it, a block Krylov space is built in passes over the packed
    features, one job each; beyond `SAMPLES_IN_PASSES` block iteration keeps the sample vectors distributed as well."""
    features, samples = shape_of(cells)
    if samples < 2 or features < 2:
        raise ValueError("Components need at least two samples and two features.")
    side = _weights(cells, samples, scale)
    joined = spread_join(cells, side, ["feature_id"], "sample_id")
    scaled = cut(joined.select("feature_id", "sample_id", (F.col("value") / F.col("_sd")).alias("value"),
                               (F.col("_mean") / F.col("_sd")).alias("shift")))
    total = side.agg(F.sum(F.col("var_samp") / (F.col("_sd") * F.col("_sd")))).first()[0] or 0.0
    k = min(k, samples, features)
    beyond = _eigen_passes if samples <= SAMPLES_IN_PASSES else _eigen_blocks
    solve = beyond if min(features, samples) > driver_limit else _eigen_features if features < samples else _eigen_small
    vectors, values = solve(scaled, side, samples, k)
    return _components(scaled, vectors, values, total, samples, k)


def _eigen_small(scaled: DataFrame, side: DataFrame, samples: int, k: int):
    spark = scaled.sparkSession
    linear = scaled.groupBy("sample_id").agg(F.sum(F.col("value") * F.col("shift")).alias("_l")).toPandas()
    constant = side.agg(F.sum((F.col("_mean") / F.col("_sd")) ** 2)).first()[0]
    names = sorted(linear["sample_id"])
    position = {name: i for i, name in enumerate(names)}
    pairs = gram(scaled.drop("shift")).toPandas()  # samples <= driver_limit
    g = np.zeros((samples, samples))
    a, b = pairs["sample_a"].map(position).to_numpy(), pairs["sample_b"].map(position).to_numpy()
    g[a, b] = pairs["product"]
    g[b, a] = pairs["product"]
    l = linear.set_index("sample_id")["_l"].reindex(names).to_numpy()
    g = g - l[:, None] - l[None, :] + constant
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(-values)[:k]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    rows = [(names[i], [float(v) for v in vectors[i]]) for i in range(samples)]
    return spark.createDataFrame(rows, "sample_id string, u array<double>"), values


def _eigen_features(scaled: DataFrame, side: DataFrame, samples: int, k: int):
    """The same from the products between features: sample vectors are the data times the feature vectors."""
    shifts = side.select("feature_id", (F.col("_mean") / F.col("_sd")).alias("shift")).orderBy("feature_id").toPandas()  # features <= driver_limit
    names, shift = shifts["feature_id"].tolist(), shifts["shift"].to_numpy(float)
    position = {name: i for i, name in enumerate(names)}
    pairs = gram(scaled.select(F.col("sample_id").alias("feature_id"), F.col("feature_id").alias("sample_id"), "value")).toPandas()
    g = np.zeros((len(names), len(names)))
    a, b = pairs["sample_a"].map(position).to_numpy(), pairs["sample_b"].map(position).to_numpy()
    g[a, b] = pairs["product"]
    g[b, a] = pairs["product"]
    g = g - samples * np.outer(shift, shift)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(-values)[:k]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    length = np.sqrt(values)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 1e-12 * max(length.max(), 1e-300))
    base = shift @ vectors
    table = scaled.sparkSession.createDataFrame([(n, [float(x) for x in vectors[i]]) for i, n in enumerate(names)], "feature_id string, w array<double>")
    sums = [(F.sum(F.col("value") * F.col("w")[i]) - F.lit(float(base[i]))).alias(f"_{i}") for i in range(k)]
    projected = spread_join(scaled, table, ["feature_id"], "sample_id").groupBy("sample_id").agg(*sums)
    return cut(projected.select("sample_id", F.array(*[F.col(f"_{i}") for i in range(k)]).alias("u"))), values


def _packed_features(scaled: DataFrame, names: list[str]) -> DataFrame:
    """(shift, i, v): a row a feature, with the places of its samples and its values."""
    spark = scaled.sparkSession
    places = spark.createDataFrame(pd.DataFrame({"sample_id": names, "i": np.arange(len(names), dtype=np.int32)}), "sample_id string, i int")
    cells = spread_join(scaled, places, ["sample_id"], "feature_id")
    packed = cells.groupBy("feature_id").agg(F.first("shift").alias("shift"), F.collect_list(F.struct("i", "value")).alias("c"))
    return cut(packed.select("shift", F.col("c.i").alias("i"), F.col("c.value").alias("v")).repartition(2 * spark.sparkContext.defaultParallelism))


def _apply_gram(packed: DataFrame, block: np.ndarray) -> np.ndarray:
    """XX'U of the centred data in one pass: every feature meets the block and goes back into the sums at once."""
    n, width = block.shape
    shared = packed.sparkSession.sparkContext.broadcast(block)
    chunk = max(1, 65_536 // width)

    def work(batches):
        u = shared.value
        total, sums, moved = np.zeros((n, width)), u.sum(0), np.zeros(width)
        for batch in batches:
            lists = batch.column("i")
            length = np.diff(lists.offsets.to_numpy())
            i, v = lists.flatten().to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            shift = batch.column("shift").to_numpy(zero_copy_only=False)
            if not len(i):
                continue
            y = np.add.reduceat(u[i] * v[:, None], np.cumsum(length) - length) - shift[:, None] * sums
            moved += shift @ y
            back = np.repeat(y, length, axis=0) * v[:, None]
            for k in range(width):
                total[:, k] += np.bincount(i, back[:, k], n)
        total -= moved
        for first in range(0, n, chunk):
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total[first:first + chunk].ravel()], pa.list_(pa.float64()))], ["first", "z"])

    def together(key, frame):
        return pd.DataFrame({"first": [key[0]], "z": [np.sum([np.asarray(z) for z in frame["z"]], axis=0)]})

    schema = "first int, z array<double>"
    out = np.zeros((n, width))
    for r in packed.mapInArrow(work, schema).groupBy("first").applyInPandas(together, schema).collect():  # samples x columns of the block
        out[r["first"]:r["first"] + chunk] = np.array(r["z"]).reshape(-1, width)
    shared.unpersist()
    return out


def _eigen_passes(scaled: DataFrame, side: DataFrame, samples: int, k: int, passes: int = 1000, tolerance: float = 1e-8):
    """Block Krylov space of XX' with full orthogonalisation, restarted from its best vectors when it is full. Done when the residuals
    of the k largest are below `tolerance` of the largest value."""
    names = sorted(r[0] for r in scaled.select("sample_id").distinct().collect())
    packed = _packed_features(scaled, names)
    width = min(samples, k + SPARE_COLUMNS)
    most = max(6 * width, min(samples, BASIS_BYTES // (8 * samples)) // width * width)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((samples, width)))[0]
    small, done = np.zeros((0, 0)), 0  # of the basis, the columns that have been multiplied
    for _ in range(passes):
        new = basis[:, done:]
        z = _apply_gram(packed, new)
        inside = basis.T @ z
        grown = np.zeros((basis.shape[1],) * 2)
        grown[:done, :done] = small
        grown[:, done:] = inside
        grown[done:, :done] = inside[:done].T
        small, done = (grown + grown.T) / 2, basis.shape[1]
        rest = z - basis @ inside
        rest -= basis @ (basis.T @ rest)
        onward, over = np.linalg.qr(rest)
        values, vectors = np.linalg.eigh(small)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        residual = np.linalg.norm(over @ vectors[-new.shape[1]:, :k], axis=0)
        if (residual <= tolerance * max(values[0], 1e-300)).all() or done == samples:
            best = basis @ vectors[:, :k]
            table = pd.DataFrame({"sample_id": names, "u": list(best)})
            return cut(scaled.sparkSession.createDataFrame(table, "sample_id string, u array<double>")), np.maximum(values[:k], 0.0)
        onward = np.linalg.qr(onward - basis @ (basis.T @ onward))[0][:, :samples - done]
        if done + width > most:
            kept = max(2 * width, most // 2 // width * width)
            basis, small, done = basis @ vectors[:, :kept], np.diag(values[:kept]), kept
        basis = np.hstack([basis, onward])
    raise RuntimeError("The component iteration did not converge; ask for fewer components.")


def _columns(name: str, size: int) -> list:
    return [F.col(name)[i] for i in range(size)]


def _eigen_blocks(scaled: DataFrame, side: DataFrame, samples: int, k: int, rounds: int = 100, tolerance: float = 1e-10):
    """Block power iteration with Rayleigh-Ritz on X'X, where X is applied as two joins."""
    width = min(samples, k + 10)
    shifts = side.select("feature_id", (F.col("_mean") / F.col("_sd")).alias("shift"))
    start = [(F.pmod(F.xxhash64(F.col("sample_id"), F.lit(i)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(f"_{i}") for i in range(width)]
    block = scaled.select("sample_id").distinct().select("sample_id", F.array(*start).alias("u"))
    block = cut(_orthonormal(block, width))
    previous = None
    for _ in range(rounds):
        column_sums = block.agg(F.array(*[F.sum(c) for c in _columns("u", width)]).alias("_t"))
        y = spread_join(scaled, block, ["sample_id"], "feature_id").groupBy("feature_id").agg(
            F.array(*[F.sum(F.col("value") * c) for c in _columns("u", width)]).alias("y"))
        y = cut(one_row(y.join(shifts, "feature_id"), column_sums).select(
            "feature_id", "shift", F.zip_with("y", F.transform("_t", lambda t: t * F.col("shift")), lambda p, q: p - q).alias("y")))
        mean_part = y.agg(F.array(*[F.sum(F.col("shift") * c) for c in _columns("y", width)]).alias("_t"))
        z = spread_join(scaled.drop("shift"), y.drop("shift"), ["feature_id"], "sample_id").groupBy("sample_id").agg(
            F.array(*[F.sum(F.col("value") * c) for c in _columns("y", width)]).alias("z"))
        z = cut(one_row(z, mean_part).select("sample_id", F.zip_with("z", "_t", lambda p, q: p - q).alias("z")))
        both = block.join(z, "sample_id")
        u, v = _columns("u", width), _columns("z", width)
        small = np.array(both.agg(*[F.sum(u[i] * v[j]) for i in range(width) for j in range(width)]).first()).reshape(width, width)
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, rotation = values[order], rotation[:, order]
        done = previous is not None and np.all(np.abs(values[:k] - previous[:k]) <= tolerance * max(values[0], 1e-300))
        previous = values
        if done:
            best = both.select("sample_id", _rotate("u", rotation[:, :k]).alias("u"))
            return cut(best), np.maximum(values[:k], 0.0)
        block = cut(_orthonormal(z.select("sample_id", _rotate("z", rotation).alias("u")), width))
    raise RuntimeError("The component iteration did not converge; ask for fewer components.")


def _rotate(name: str, matrix: np.ndarray):
    terms = []
    for j in range(matrix.shape[1]):
        value = F.lit(0.0)
        for i in range(matrix.shape[0]):
            value = value + F.col(name)[i] * F.lit(float(matrix[i, j]))
        terms.append(value)
    return F.array(*terms)


def _orthonormal(block: DataFrame, width: int) -> DataFrame:
    u = _columns("u", width)
    g = np.array(block.agg(*[F.sum(u[i] * u[j]) for i in range(width) for j in range(width)]).first()).reshape(width, width)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    floor = max(values.max(), 1e-300) * 1e-14
    return block.select("sample_id", _rotate("u", vectors / np.sqrt(np.maximum(values, floor))).alias("u"))


def _components(scaled: DataFrame, vectors: DataFrame, values: np.ndarray, total: float, samples: int, k: int) -> Components:
    spark = scaled.sparkSession
    singular = np.sqrt(values)
    usable = [float(s) if s > 1e-12 * max(singular.max(), 1e-300) else math.inf for s in singular]
    loaded = spread_join(scaled, vectors, ["sample_id"], "feature_id").groupBy("feature_id").agg(
        F.array(*[F.sum(F.col("value") * F.col("u")[i]) / F.lit(usable[i]) for i in range(k)]).alias("v"))
    loaded = cut(loaded)
    pivots = loaded.agg(*[F.min_by(F.signum(F.col("v")[i]), F.struct(-F.abs(F.col("v")[i]), F.col("feature_id"))) for i in range(k)]).first()
    signs = [-1.0 if (s or 0) < 0 else 1.0 for s in pivots]

    def long(df: DataFrame, key: str, name: str, factors: list[float]) -> DataFrame:
        scaled_array = F.array(*[F.col(name)[i] * F.lit(factors[i]) for i in range(k)])
        return df.select(key, F.posexplode(scaled_array).alias("_p", "value")).select(
            key, F.concat(F.lit("PC"), (F.col("_p") + 1).cast("string")).alias("component"), "value")

    explained = [float(v) / max(samples - 1, 1) for v in values]
    rows = [(f"PC{i + 1}", explained[i], explained[i] / total if total > 0 else 0.0) for i in range(k)]
    return Components(
        long(vectors, "sample_id", "u", [s * float(x) for s, x in zip(signs, singular)]),
        long(loaded, "feature_id", "v", signs),
        spark.createDataFrame(rows, "component string, explained_variance double, explained_ratio double"))

"""Shallot search against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from exprspark.llm import shallot


def plain(rows, clusters, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of) if c == k]
            if mine:
                centres[k] = [sum(col) // len(mine) for col in zip(*mine)]
    done = [(i, *nearest(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, c in done if c == k) for k in range(len(centres))}
    text = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centres)}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), text[c]) for i, d, c in done), key=str)


def ours(spark, rows, **given):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    return sorted([tuple(r) for r in shallot.cluster(frame, **given).collect()], key=str)


@pytest.mark.parametrize("case", range(3))
def test_equals_plain_k_means(spark, case):
    rng = random.Random(case)
    coarse = case == 1  # a coarse grid makes equal distances and equal centroids common
    rows = [(i, [rng.choice([0.0, 0.01, -0.01]) if coarse else rng.gauss(rng.choice([-1, 0, 1]), 0.5) for _ in range(4)]) for i in range(150)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert ours(spark, rows, clusters=9, rounds=4, dimensions=4) == plain(rows, 9, 4, 4)


def test_odd_rows_are_dropped_or_defined(spark):
    good = [float(x) for x in range(4)]
    rows = [(1, good), (1, good), (None, [0.5] * 4), (2, None), (3, []), (4, [1.0, None, 0.0, 0.0]), (5, [1.0, math.nan, 0.0, 0.0]), (6, [math.inf] * 4), (7, [1.0] * 5), (8, [1e38] * 4), (9, [-1e38] * 4)]
    got = ours(spark, rows, clusters=3, rounds=2, dimensions=4)
    assert got == plain(rows, 3, 2, 4) and [r[0] for r in got].count(1) == 2 and len(got) == 5


@pytest.mark.parametrize("rows", [[], [(1, [0.1] * 4)], [(1, [0.1] * 4), (2, [0.1] * 4)]])
def test_few_vectors(spark, rows):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert ours(spark, rows, clusters=5, rounds=3, dimensions=4) == plain(rows, 5, 3, 4)


def test_other_columns_are_ignored(spark):
    frame = spark.createDataFrame([(1, [0.1] * 4, 7, 8, 9)], "vec_id bigint, embedding array<float>, cluster int, one int, v int")
    assert shallot.cluster(frame, clusters=2, dimensions=4).count() == 1


def test_search_is_exact_and_leaves_centroids_unmeasured(monkeypatch):
    rng = np.random.default_rng(1)
    homes = rng.integers(-2000, 2000, (30, 8))
    rows = homes[rng.integers(0, 30, 4000)] + rng.integers(-40, 40, (4000, 8))
    centroids = shallot.Centroids(homes.tolist())
    seen = []
    plain_squared = shallot.squared
    monkeypatch.setattr(shallot, "squared", lambda r, c: seen.append(len(r)) or plain_squared(r, c))
    one = rng.integers(0, 30, 4000)
    first, second, d1, d2 = shallot.search(rows, one, (one + 1) % 30, centroids)
    full = ((rows[:, None, :] - homes[None]) ** 2).sum(2)
    assert (first == full.argmin(1)).all() and (d1 == full.min(1)).all() and (d2 == np.sort(full, 1)[:, 1]).all()
    assert sum(seen) < full.size
    # a second search from where the first ended scans only a small ball
    seen.clear()
    shallot.search(rows, first, second, centroids)
    assert sum(seen) < 0.35 * full.size

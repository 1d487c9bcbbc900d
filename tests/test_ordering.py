"""Bucketed paths against brute force; a third of the rows share one key or value."""

import random

import numpy as np
import pandas as pd
import pytest

from exprspark.functions import ordering as O
from exprspark.operators.linear import bh_adjust


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(600):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(5)}"
        value = 1.0 if i % 4 == 0 else round(rng.uniform(-3, 3), 2)
        out.append((group, f"id{i:04d}", value, rng.randrange(1, 4)))
    return out


def frame(rows):
    return pd.DataFrame(rows, columns=["g", "id", "v", "w"])


@pytest.mark.parametrize("limit", [10_000, 40])
def test_row_numbers_and_running_sums(spark, rows, limit):
    df = spark.createDataFrame(rows, "g string, id string, v double, w int")
    got = O.row_numbers(df, ["g"], ["v", "id"], "rn", rows_per_task=limit).toPandas().sort_values("id")
    want = frame(rows).sort_values(["g", "v", "id"])
    want["rn"] = want.groupby("g").cumcount() + 1
    assert got["rn"].tolist() == want.sort_values("id")["rn"].tolist()
    sums = O.running(df, [], ["v", "id"], ["w"], rows_per_task=limit).toPandas().sort_values(["v", "id"])
    assert sums["w_before"].tolist() == (sums["w"].cumsum() - sums["w"]).tolist()


@pytest.mark.parametrize("limit", [10_000, 30])
def test_ranks_quantiles_suffix_min(spark, rows, limit):
    df = spark.createDataFrame(rows, "g string, id string, v double, w int")
    ranks = O.average_ranks(df, ["g"], "v", rows_per_task=limit).toPandas().set_index(["g", "v"])["avg_rank"]
    pdf = frame(rows)
    want = pdf.assign(r=pdf.groupby("g")["v"].rank())
    for _, row in want.iterrows():
        assert ranks[(row["g"], row["v"])] == row["r"]
    q = O.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5}, rows_per_task=limit).toPandas().set_index("g")
    for name, part in pdf.groupby("g"):
        assert q.loc[name, "a"] == pytest.approx(np.quantile(part["v"], 0.25))
        assert q.loc[name, "b"] == pytest.approx(np.quantile(part["v"], 0.5))
    low = O.suffix_min(df, ["g"], ["id"], "v", "m", rows_per_task=limit).toPandas().sort_values(["g", "id"])
    for _, part in low.groupby("g"):
        assert part["m"].tolist() == part["v"][::-1].cummin()[::-1].tolist()


def test_joins_keep_every_row_of_a_hot_key(spark, rows):
    df = spark.createDataFrame(rows, "g string, id string, v double, w int")
    dim = df.groupBy("g").count()
    for joined in (O.spread_join(df, dim, ["g"], "id"), O.counted_join(df, dim, ["g"], "count", rows_per_task=100),
                   O.counted_join(df, dim.where("g <> 'g1'"), ["g"], "count", "left", rows_per_task=100)):
        out = joined.toPandas()
        assert sorted(out["id"]) == sorted(r[1] for r in rows)
    assert set(O.spread_join(df, dim, ["g"], "id").where("g = 'hot'").toPandas()["count"]) == {200}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_never_broadcasts_the_repeated_side(spark, tmp_path, how):
    """A dimension of small files is read as small, but has eight times its rows when it is joined."""
    spark.range(4000).selectExpr("cast(id as string) g", "id % 7 as w").write.parquet(str(tmp_path / "dim"))
    facts = spark.range(20000).selectExpr("cast(id % 5000 as string) g", "cast(id as string) id")
    joined = O.spread_join(facts, spark.read.parquet(str(tmp_path / "dim")), ["g"], "id", how)
    assert joined.where("w is not null").count() == 16000 and joined.count() == (16000 if how == "inner" else 20000)
    joined.collect()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [None, 25])
def test_bh_matches_the_textbook(spark, limit):
    rng = np.random.default_rng(1)
    p = np.where(np.arange(300) % 3 == 0, 1.0, np.round(rng.uniform(0, 1, 300), 3))
    got = bh_adjust(spark.createDataFrame([(f"f{i}", float(x)) for i, x in enumerate(p)] + [("none", None)], "id string, p_value double"),
                    rows_per_task=limit).toPandas().set_index("id")["adjusted_p_value"]
    order = np.argsort(p)
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert np.isnan(got["none"])
    np.testing.assert_allclose([got[f"f{i}"] for i in order], want)
    assert (np.array([got[f"f{i}"] for i in range(300)]) >= p - 1e-12).all()

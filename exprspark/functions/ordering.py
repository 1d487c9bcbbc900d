"""Ranks, running sums and exact quantiles that never put a whole group into one task.

A plain window sorts each group inside one task. Here a group is first cut at split values into
ordered buckets: one window runs inside each (group, bucket), and the bucket totals (a few hundred
rows per group) give each bucket its offset. The split values come from a small sample and only
steer balance: the result is exact whatever they are. Inputs below `ROWS_PER_TASK` rows keep the
plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprspark.session import cut

ROWS_PER_TASK = 1_000_000
SAMPLE_ROWS = 20_000
MAX_BUCKETS = 1024
SALTS = 8


def spread_join(facts: DataFrame, dim: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Equi-join of a large table with one row (or a few) per key. The key may be hot in `facts`,
    so its rows are spread over `SALTS` reducers by another column, and what is still uneven is left
    to adaptive skew splitting. Both sides are shuffled: Spark judges `dim` by the bytes of its files,
    before its rows are repeated, and a broadcast of those passes the driver."""
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")
    return facts.withColumn("_salt", salt).join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def _splits(df: DataFrame, order: Sequence[str], rows_per_task: int) -> list[tuple]:
    total = df.count()
    if total <= rows_per_task:
        return []
    buckets = min(MAX_BUCKETS, max(2, 2 * total // rows_per_task))
    rows = df.select(*order).sample(min(1.0, SAMPLE_ROWS / total), seed=7).collect()  # about SAMPLE_ROWS
    points = sorted({tuple(r) for r in rows if None not in tuple(r)})
    step = max(1, len(points) // buckets)
    return points[step::step]


def _bucket(order: Sequence[str], splits: list[tuple], types: list) -> Column:
    """Index of the ordered bucket, by bisection over the literal split rows."""
    key = F.struct(*[F.col(c) for c in order])

    def point(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, values, types)])

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= point(splits[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(splits))


def _ordered(df: DataFrame, by: Sequence[str], order: Sequence[str], rows_per_task: int):
    """(frame, grouping columns incl. bucket, splits used). The input is written once, because its
    size, its sample, its totals and its rows are all read from it."""
    df = cut(df)
    probe = _splits(df, order, rows_per_task)
    if not probe:
        return df, list(by), False
    types = [df.schema[c].dataType for c in order]
    return df.withColumn("_bucket", _bucket(order, probe, types)), [*by, "_bucket"], True


def _window(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Adds `<c>_before`: the sum of c over earlier rows of the group in ascending `order`, which
    must be a total order within the group."""
    df, keys, cut_up = _ordered(df, by, order, rows_per_task or ROWS_PER_TASK)
    inside = _window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_before") for c in sums])
    if not cut_up:
        return out
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = _window(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    joined = out.join(offsets, keys)
    for c in sums:
        joined = joined.withColumn(f"{c}_before", F.col(f"{c}_before") + F.col(f"_o_{c}"))
    return joined.drop("_bucket", *[f"_o_{c}" for c in sums])


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn", rows_per_task: int | None = None
) -> DataFrame:
    """1-based position in ascending `order` (a total order) within each group."""
    out = running(df.withColumn("_one", F.lit(1)), by, order, ["_one"], rows_per_task)
    return out.withColumn(name, (F.col("_one_before") + 1).cast("bigint")).drop("_one", "_one_before")


def suffix_min(
    df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str, rows_per_task: int | None = None
) -> DataFrame:
    """Smallest value of `column` over this and all later rows of the group."""
    df, keys, cut_up = _ordered(df, by, order, rows_per_task or ROWS_PER_TASK)
    inside = _window(keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn(name, F.min(column).over(inside))
    if not cut_up:
        return out
    later = _window(by).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    lows = df.groupBy(*keys).agg(F.min(column).alias("_low"))
    offsets = lows.select(*keys, F.min("_low").over(later).alias("_later"))
    return out.join(offsets, keys).withColumn(name, F.least(name, "_later")).drop("_bucket", "_later")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, rows_per_task: int | None = None) -> DataFrame:
    """One row per (group, distinct value): count `ties`, and the average rank of those ties.
    Ties are counted before anything is sorted, so a value shared by most rows costs one row."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return rank_ties(ties, by, value, rows_per_task)


def rank_ties(ties: DataFrame, by: Sequence[str], value: str, rows_per_task: int | None = None) -> DataFrame:
    out = running(ties, by, [value], ["ties"], rows_per_task)
    return out.withColumn("avg_rank", F.col("ties_before") + (F.col("ties") + 1) / 2.0)


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], rows_per_task: int | None = None, largest: int | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group (NULLs ignored). Groups that fit a task use
    the built-in percentile; beyond that the values are counted and ranked in buckets. Pass the
    largest group's size when it is known."""
    limit = rows_per_task or ROWS_PER_TASK
    df = df.where(F.col(value).isNotNull())
    if (largest if largest is not None else largest_group(df, by)) <= limit:
        return df.groupBy(*by).agg(*[F.percentile(value, p).alias(n) for n, p in probs.items()])
    return tie_quantiles(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties")), by, value, probs, limit)


def tie_quantiles(ties: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], rows_per_task: int | None = None) -> DataFrame:
    """Quantiles from counted values: (group, value, ties)."""
    placed = running(ties, by, [value], ["ties"], rows_per_task)
    sizes = ties.groupBy(*by).agg(F.sum("ties").alias("_n"))
    placed = placed.join(sizes, list(by)) if by else one_row(placed, sizes)
    first, last = F.col("ties_before"), F.col("ties_before") + F.col("ties")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < last), F.col(value)))

    columns = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(p)
        low, high = at(F.floor(h)), at(F.ceil(h))
        columns.append((low + (high - low) * F.max(h - F.floor(h))).alias(name))
    return placed.groupBy(*by).agg(*columns)


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median", largest: int | None = None) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5}, largest=largest)


def one_row(df: DataFrame, side: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row."""
    return df.crossJoin(F.broadcast(side))


def counted_join(facts: DataFrame, dim: DataFrame, keys: list[str], count: str, how: str = "inner", rows_per_task: int | None = None) -> DataFrame:
    """Join facts to one row per key that knows how many facts it has. Keys with more than a task's
    rows are few (total / limit) and are broadcast; the other keys are shuffled."""
    hot = dim.where(F.col(count) > (rows_per_task or ROWS_PER_TASK))
    if hot.isEmpty():
        return facts.join(dim, keys, how)
    cold = dim.where(F.col(count) <= (rows_per_task or ROWS_PER_TASK))
    rest = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return facts.join(F.broadcast(hot), keys).unionByName(rest)

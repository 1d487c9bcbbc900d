"""Agglomerative clustering in rounds of mutual nearest neighbours.

Average, complete and Ward linkage are reducible: merging every pair of clusters that are each
other's nearest gives the tree of one-at-a-time merging. A round is a few joins over the pair
table, whose size falls with the clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import row_numbers
from exprspark.session import cut

MERGE = "left string, right string, distance double, sample_count bigint, round int"


def linkage(distances: DataFrame, method: str = "average", metric: str = "euclidean") -> DataFrame:
    """Merges (left, right, distance, sample_count). A cluster goes by its smallest sample id, which
    it keeps as `left` of a merge; `right` is absorbed. distances: sample_a < sample_b."""
    if method not in ("average", "complete", "ward"):
        raise ValueError("Linkage must be average, complete or ward.")
    if method == "ward" and metric != "euclidean":
        raise ValueError("Ward linkage needs euclidean distance.")
    # Ward works on squared distances between centroids
    value = F.col("distance") ** 2 if method == "ward" else F.col("distance")
    one = F.lit(1).cast("bigint")
    pairs = cut(distances.select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"), value.alias("d"), one.alias("na"), one.alias("nb")))
    done, step = [], 0
    while True:
        step += 1
        merges = cut(_mutual(pairs, method).withColumn("round", F.lit(step)))
        if merges.isEmpty():
            break
        done.append(merges.select("left", "right", "distance", (F.col("na") + F.col("nb")).alias("sample_count"), "round"))
        pairs = cut(_merge(pairs, merges, method))
    out = done[0] if done else pairs.sparkSession.createDataFrame([], MERGE)
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _mutual(pairs: DataFrame, method: str) -> DataFrame:
    """Pairs of clusters that are each other's nearest."""
    size = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    height = F.sqrt(2 * size * F.col("d")) if method == "ward" else F.col("d")
    end = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))
    sides = pairs.select(F.explode(end).alias("e"), height.alias("h"), "a", "b", "na", "nb").select("e.*", "h", "a", "b", "na", "nb")
    nearest = sides.groupBy("c").agg(F.min_by(F.struct("a", "b", "na", "nb", "h"), F.struct("h", "o")).alias("m")).select("m.*")
    return nearest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"), F.min("na").alias("na"), F.min("nb").alias("nb"), F.min("h").alias("distance")).where(
        "votes = 2").select(F.col("a").alias("left"), F.col("b").alias("right"), "distance", "na", "nb")


def _merge(pairs: DataFrame, merges: DataFrame, method: str) -> DataFrame:
    """Distances between the clusters after all of a round's merges."""
    size = F.col("na") + F.col("nb")
    # how far a merged Ward cluster's parts lie from its centroid
    spread = F.col("distance") ** 2 / (2 * size) if method == "ward" else F.lit(0.0)
    moved = merges.select(F.explode(F.array("left", "right")).alias("c"), F.col("left").alias("to"), size.alias("n"), spread.alias("s"))

    def side(name: str) -> DataFrame:
        return moved.select(F.col("c").alias(name), F.col("to").alias(f"t{name}"), F.col("n").alias(f"m{name}"), F.col("s").alias(f"s{name}"))

    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "d", (F.col("na") * F.col("nb")).alias("w"),
        F.coalesce("ma", "na").alias("na"), F.coalesce("mb", "nb").alias("nb"), F.coalesce("sa", F.lit(0.0)).alias("sa"), F.coalesce("sb", F.lit(0.0)).alias("sb"))
    swap = F.col("a") > F.col("b")
    ordered = joined.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d", "w", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), (F.col("sa") + F.col("sb")).alias("s"))
    d = F.max("d") if method == "complete" else F.greatest(F.sum(F.col("w") * F.col("d")) / F.sum("w") - F.max("s"), F.lit(0.0))
    return ordered.groupBy("a", "b").agg(d.alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def cut_tree(merges: DataFrame, clusters: int) -> DataFrame:
    """(sample_id, cluster) with at most `clusters` groups: all merges up to the height that leaves
    so many. Clusters are numbered by their smallest sample id; membership follows the pointers
    right -> left, doubled every round."""
    merges = cut(merges)
    samples = merges.count() + 1
    nodes = merges.select(F.explode(F.array("left", "right")).alias("sample_id")).distinct()
    if clusters >= samples:
        top = None
    else:
        placed = row_numbers(merges, [], ["distance", "left", "right"], "rn")
        top = placed.where(F.col("rn") == samples - clusters).first()["distance"]
    joined = merges.where(F.col("distance") <= F.lit(top)) if top is not None else merges.where("false")
    parent = cut(nodes.join(joined.select(F.col("right").alias("sample_id"), F.col("left").alias("root")), "sample_id", "left").select(
        "sample_id", F.coalesce("root", "sample_id").alias("root")))
    while True:
        onward = parent.select(F.col("sample_id").alias("root"), F.col("root").alias("next"))
        following = cut(parent.join(onward, "root").select("sample_id", "root", "next"))
        moved = following.where("root <> next").isEmpty()
        parent = following.select("sample_id", F.col("next").alias("root"))
        if moved:
            break
    numbered = row_numbers(parent.select("root").distinct(), [], ["root"], "cluster")
    return parent.join(numbered, "root").select("sample_id", "cluster")

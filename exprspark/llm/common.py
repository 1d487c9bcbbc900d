"""Reading, row keys, Arrow slices and graph components shared by the document operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprspark.session import cut, ship

SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """64-bit key of a text. It only groups work; what depends on equality is checked on the texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of an Arrow batch whose texts hold about `limit` bytes; one longer text goes alone."""
    sizes = batch.column(text).cast(pa.large_binary()) if batch.num_rows else []
    start, held = 0, 0
    for i, value in enumerate(pa.compute.binary_length(sizes).to_pylist() if batch.num_rows else []):
        size = value or 0
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable from each node of `edges` (u, v).

    Alternating large and small stars (Kiveris et al. 2014): each step replaces a node's links by
    links to its smallest neighbour, so a path shortens geometrically. A node of any degree costs
    one aggregated row and a join that adaptive execution can split; steps are written to the shared
    folder, in at most `parts` files where the number of nodes is known. It ends when no root is itself a child and no
    child has two roots.
    """
    current = edges.where("u <> v").select("u", "v")
    done = 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        down = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = small.select("e.u", "e.v").where("u <> v").distinct()
        current = cut(stars.coalesce(parts) if parts else stars)
        done += 1
        if done > 1:
            children = current.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
            nested = children.where("n > 1").select("u").unionByName(children.join(current.select(F.col("v").alias("u")), "u", "left_semi").select("u"))
            if nested.isEmpty():
                break
    return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")

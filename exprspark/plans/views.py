"""The driver tables read as cohort shapes: matrix, metadata, features, sets, assignments.

Each shape exists twice: as a DataFrame here, and as the SQL text in `SQL` that another engine can
run on the same tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprspark.session import cut, ship


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def counts_once(self) -> DataFrame:
        """The cell table, for queries of one job: a plan that reads it twice shares its shuffle."""
        return self.table("lineitem").groupBy(
            F.col("l_partkey").cast("string").alias("feature_id"), F.col("l_suppkey").cast("string").alias("sample_id")
        ).agg(F.sum("l_quantity").alias("value"))

    @cached_property
    def counts(self) -> DataFrame:
        """The cell table, written once: for operators of several jobs over their matrix."""
        return cut(self.counts_once)

    @cached_property
    def meta(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").cast("string").alias("sample_id"), F.col("r_name").alias("condition"),
                    F.col("n_name").alias("batch"), F.col("s_acctbal").alias("covariate"))
        )

    def _counts_by(self, column: str) -> DataFrame:
        side = self.meta.select(F.col("sample_id").cast("bigint").alias("l_suppkey"), F.col(column).alias("sample_id"))
        joined = self.table("lineitem").join(side, "l_suppkey")
        return cut(joined.groupBy(F.col("l_partkey").cast("string").alias("feature_id"), "sample_id").agg(F.sum("l_quantity").alias("value")))

    @cached_property
    def region_counts(self) -> DataFrame:
        return self._counts_by("condition")

    @cached_property
    def nation_counts(self) -> DataFrame:
        return self._counts_by("batch")

    @cached_property
    def feat(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_brand").alias("symbol"),
            F.col("p_name").alias("gene_name"), F.col("p_type").alias("biotype"), F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"))

    @cached_property
    def sets(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_type").alias("set_id"), F.col("p_partkey").cast("string").alias("feature_id"),
            F.col("p_size").cast("double").alias("weight"))

    @cached_property
    def embed(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("sample_id"), F.posexplode("embedding").alias("pos", "v")
        ).select(F.format_string("f%03d", "pos").alias("feature_id"), "sample_id", F.col("v").cast("double").alias("value"))

    @cached_property
    def embed_meta(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("sample_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))

    @cached_property
    def embed_sets(self) -> DataFrame:
        """Four overlapping feature blocks with weights, read off the feature positions."""
        features = self.embed.select("feature_id").distinct()
        position = F.substring("feature_id", 2, 3).cast("int")
        return features.select(
            F.explode(F.array(F.concat(F.lit("tens"), F.floor(position / 10)), F.concat(F.lit("twenties"), F.floor(position / 20)))).alias("set_id"),
            "feature_id", (position - 31.5).alias("weight"))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.table("events").groupBy(
            F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("measurement_id"),
            F.col("user_id").cast("string").alias("biological_sample_id"), F.col("event_type").alias("condition"),
        ).agg(
            F.date_format(F.min("ts"), "yyyy-MM-dd").alias("run"), F.avg("value").alias("value"),
            F.min("value").alias("quality_metric"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def measurement_cells(self) -> DataFrame:
        """Profile of each measurement: mean value by day of month."""
        return self.table("events").groupBy(
            F.date_format("ts", "dd").alias("feature_id"),
            F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("sample_id"),
        ).agg(F.avg("value").alias("value"))

    @cached_property
    def levels(self) -> DataFrame:
        per = self.table("orders").groupBy(
            F.col("o_custkey").cast("string").alias("biological_sample_id"), F.substring("o_orderpriority", 1, 1).cast("double").alias("level")
        ).agg(F.avg("o_totalprice").alias("price"), F.min("o_orderdate").alias("first_order"))
        return per.select(
            "biological_sample_id", "level", F.concat_ws("-", "biological_sample_id", F.col("level").cast("int").cast("string")).alias("measurement_id"),
            (F.col("price") / 500000.0).alias("score"),
            F.when(F.col("price") >= 250000.0, "high").otherwise("low").alias("call"),
            (F.col("price") < 100000.0).alias("qc_failure"), F.date_format("first_order", "yyyy").alias("run"))

    @cached_property
    def replicates(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("measurement_id"), F.col("user_id").cast("string").alias("biological_sample_id"),
            F.col("event_type").alias("operator"), F.dayofmonth("ts").alias("day"), F.col("value").alias("score"),
            F.when(F.col("value") >= 10.0, "high").otherwise("low").alias("call"))

    @cached_property
    def binary(self) -> DataFrame:
        probability = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
        return self.table("labels").join(self.table("documents"), "doc_id").select(
            F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("group"), F.col("lang").alias("cohort"),
            F.col("quality").alias("y"), probability.alias("p"))

    @cached_property
    def estimates(self) -> DataFrame:
        line = self.table("lineitem").groupBy(
            F.col("l_returnflag").alias("run"), F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_linestatus").alias("population")
        ).agg(F.sum("l_quantity").alias("q"))
        total = line.groupBy("run", "sample_id").agg(F.sum("q").alias("total"))
        return line.join(total, ["run", "sample_id"]).select("run", "sample_id", "population", (F.col("q") / F.col("total")).alias("value"))


SQL = {
    "m_counts": "select cast(l_partkey as varchar) feature_id, cast(l_suppkey as varchar) sample_id, sum(l_quantity) as value from lineitem group by 1, 2",
    "m_meta": "select cast(s_suppkey as varchar) sample_id, r_name as condition, n_name as batch, s_acctbal as covariate from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "m_region": "select feature_id, m.condition as sample_id, sum(value) as value from m_counts join m_meta m using (sample_id) group by 1, 2",
    "m_nation": "select feature_id, m.batch as sample_id, sum(value) as value from m_counts join m_meta m using (sample_id) group by 1, 2",
    "m_feat": "select cast(p_partkey as varchar) feature_id, p_brand as symbol, p_name as gene_name, p_type as biotype, p_size as size, p_retailprice as price from part",
    "m_sets": "select p_type as set_id, cast(p_partkey as varchar) feature_id, cast(p_size as double) as weight from part",
    "m_embed": "select cast(vec_id as varchar) sample_id, 'f' || lpad(cast(pos - 1 as varchar), 3, '0') as feature_id, cast(embedding[pos] as double) as value from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as pos from embeddings)",
    "e_meta": "select cast(vec_id as varchar) sample_id, 'c' || cast(label as varchar) as label from embeddings",
    "e_sets": "select unnest(['tens' || cast(cast(substr(feature_id, 2, 3) as int) // 10 as varchar), 'twenties' || cast(cast(substr(feature_id, 2, 3) as int) // 20 as varchar)]) as set_id, feature_id, cast(substr(feature_id, 2, 3) as int) - 31.5 as weight from (select distinct feature_id from m_embed)",
    "a_pairs": "select cast(user_id as varchar) || '-' || event_type as measurement_id, cast(user_id as varchar) as biological_sample_id, event_type as condition, strftime(min(ts), '%Y-%m-%d') as run, avg(value) as value, min(value) as quality_metric, count(*) as n from events group by user_id, event_type",
    "a_cells": "select strftime(ts, '%d') as feature_id, cast(user_id as varchar) || '-' || event_type as sample_id, avg(value) as value from events group by 1, 2",
    "a_levels": "select biological_sample_id, level, biological_sample_id || '-' || cast(cast(level as int) as varchar) as measurement_id, price / 500000.0 as score, case when price >= 250000 then 'high' else 'low' end as call, price < 100000 as qc_failure, strftime(first_order, '%Y') as run from (select cast(o_custkey as varchar) as biological_sample_id, cast(substr(o_orderpriority, 1, 1) as double) as level, avg(o_totalprice) as price, min(o_orderdate) as first_order from orders group by o_custkey, cast(substr(o_orderpriority, 1, 1) as double))",
    "a_replicates": "select cast(event_id as varchar) as measurement_id, cast(user_id as varchar) as biological_sample_id, event_type as operator, day(ts) as day, value as score, case when value >= 10 then 'high' else 'low' end as call from events",
    "p_binary": "select cast(doc_id as varchar) as sample_id, source as \"group\", lang as cohort, quality as y, n_chars / (n_chars + 1000.0) as p from labels join documents using (doc_id)",
    "d_estimates": "select l_returnflag as run, cast(l_suppkey as varchar) as sample_id, l_linestatus as population, sum(l_quantity) / sum(sum(l_quantity)) over (partition by l_returnflag, l_suppkey) as value from lineitem group by l_returnflag, l_suppkey, l_linestatus",
}

NEEDS = {"m_region": ["m_counts", "m_meta"], "m_nation": ["m_counts", "m_meta"], "e_sets": ["m_embed"]}


def with_views(*names: str, body: str) -> str:
    """SQL text with the named shapes as common table expressions in front of `body`."""
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in ordered) + "\n" + body.strip()

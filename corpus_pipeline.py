"""Stages from raw documents to shards, each written as Parquet and read again by the next.

Rows of documents with a null doc_id or text pass through every stage like others. Columns beside those of
documents pass through too, except the last stage, which returns the placement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprspark.llm import common, decontam, mixing, neardup, sharding, toxicity
from exprspark.session import scratch_path

#: The stages draw at random, train, and cut digests, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None
#: Names that begin like this are the stages' own; any other column passes through.
KEY = "_corpus_key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    weights = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, weights, docs.columns, "_corpus_score").where("_corpus_score < 0.5").drop("_corpus_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id. Rows that repeat it are dropped as well; a component
    without any id keeps one of its rows. Blank texts stay, one row per id and text."""
    rows = neardup.near_duplicates(docs).where("kept").select("doc_id", "text_key", "root")
    chosen = rows.groupBy(F.coalesce(F.col("root"), F.xxhash64("doc_id", "text_key")).alias("group"), F.col("root").isNull().alias("blank")).agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    keys = chosen.select(F.xxhash64(F.coalesce(F.col("r.doc_id"), F.lit(-1)), F.col("r.text_key")).alias(KEY)).distinct()
    own = docs.withColumn(KEY, F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), common.text_key()))
    return own.join(keys, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaked = decontam.leaks(docs, common.table(spark, sf_dir, "benchmark")).select("text_key").distinct()
    return docs.withColumn(KEY, common.text_key()).join(leaked.withColumnRenamed("text_key", KEY), KEY, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that repeat each other are taken together."""
    def pick(source, key):
        return F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), key, F.coalesce(F.col(source), F.lit("")))

    chosen = mixing.mix(docs).groupBy(pick("source", F.col("text_key")).alias(KEY)).agg(F.sum("copies").cast("int").alias("_corpus_copies")).where("_corpus_copies > 0")
    once = docs.withColumn(KEY, pick("source", common.text_key())).join(chosen, KEY).dropDuplicates([KEY])
    return once.withColumn("_corpus_copy", F.explode(F.sequence(F.lit(1), "_corpus_copies"))).select(*docs.columns)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", place)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents; the result is the last stage's."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Versioned dataset directories and result files."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exprspark.sources.tables import SourceError

# What each assay declares about itself (value type, scale, level, suited analyses).
_EXPLORATION = ["dimension_reduction", "classifier", "signature_analysis", "deconvolution"]
ASSAYS = {
    "raw_counts": ("nonnegative_integer", "linear", "gene", ["differential_expression"]),
    "normalized_expression": ("continuous", "linear", "gene", _EXPLORATION),
    "log_expression": ("continuous", "log2", "gene", _EXPLORATION),
    "tpm": ("nonnegative_continuous", "linear", "gene", ["deconvolution"]),
    "transcript_abundance": ("nonnegative_continuous", "linear", "transcript", []),
    "probe_expression": ("continuous", "log2", "probe", []),
}


def _root(directory: str, version: int) -> str:
    return os.path.join(directory, f"version={version}")


def write_bundle(directory: str, version: int, assays: dict[str, DataFrame], **tables: DataFrame) -> str:
    """Write one immutable dataset version. Assays share one cell table partitioned by name, so a
    reader of one assay touches only its files; an existing version is never overwritten."""
    root = _root(directory, version)
    for position, (name, cells) in enumerate(assays.items()):
        if name not in ASSAYS:
            raise SourceError(f"Unknown assay '{name}'.")
        rows = cells.select(F.lit(name).alias("assay"), "feature_id", "sample_id", F.col("value").cast("double").alias("value"))
        rows.write.partitionBy("assay").mode("append" if position else "errorifexists").parquet(f"{root}/assays")
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{root}/{name}")
    spark = next(iter(assays.values())).sparkSession
    declared = [(n, *ASSAYS[n][:3], ASSAYS[n][3], version) for n in assays]
    schema = "assay STRING, value_type STRING, scale STRING, feature_level STRING, recommended_for ARRAY<STRING>, version INT"
    spark.createDataFrame(declared, schema).write.mode("errorifexists").parquet(f"{root}/manifest")
    return root


def add_assay(directory: str, version: int, name: str, cells: DataFrame) -> None:
    """Append a further assay (transcript or probe level, TPM) to a written version."""
    root = _root(directory, version)
    manifest = cells.sparkSession.read.parquet(f"{root}/manifest")
    if not manifest.where(F.col("assay") == name).isEmpty():
        raise SourceError(f"Assay '{name}' is already part of this version.")
    rows = cells.select(F.lit(name).alias("assay"), "feature_id", "sample_id", F.col("value").cast("double").alias("value"))
    rows.write.partitionBy("assay").mode("append").parquet(f"{root}/assays")
    row = cells.sparkSession.createDataFrame([(name, *ASSAYS[name][:3], ASSAYS[name][3], version)], manifest.schema)
    row.write.mode("append").parquet(f"{root}/manifest")


def scan_assay(spark: SparkSession, directory: str, version: int, name: str) -> DataFrame:
    """Cells of one assay; the filter prunes partitions."""
    cells = spark.read.parquet(f"{_root(directory, version)}/assays")
    return cells.where(F.col("assay") == name).select("feature_id", "sample_id", "value")


def assay_problems(cells: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Counts that must all be zero for a usable assay."""
    cell = cells.groupBy("feature_id", "sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max((F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).cast("int")).alias("bad"),
    )
    shape = cell.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_cells"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("non_finite_cells"),
        (F.count_distinct("feature_id") * F.count_distinct("sample_id") - F.count(F.lit(1))).alias("absent_cells"),
    )
    if meta is None:
        return shape
    missing = cells.select("sample_id").distinct().join(meta, "sample_id", "left_anti")
    return shape.crossJoin(F.broadcast(missing.agg(F.count(F.lit(1)).alias("samples_without_metadata"))))


def load_assay(spark: SparkSession, directory: str, version: int, name: str, dense: bool = True) -> DataFrame:
    """One assay, checked: no repeated or non-finite cell, every sample described, and with `dense`
    no absent cell."""
    root = _root(directory, version)
    declared = spark.read.parquet(f"{root}/manifest").where(F.col("assay") == name)
    if declared.count() != 1:
        raise SourceError(f"Assay '{name}' is missing or repeated in the dataset.")
    cells = scan_assay(spark, directory, version, name)
    found = assay_problems(cells, spark.read.parquet(f"{root}/sample_metadata")).first().asDict()
    if not dense:
        found.pop("absent_cells")
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise SourceError(f"Assay '{name}' is not usable: {broken}.")
    return cells


def write_result(df: DataFrame, path: str, fmt: str = "parquet", columns: list[str] | None = None) -> None:
    """Result table in a fixed column order, as Parquet or as tab-separated text (gzip for tsv.gz)."""
    out = df.select(*columns) if columns else df
    if fmt == "parquet":
        out.write.mode("errorifexists").parquet(path)
    elif fmt in ("tsv", "tsv.gz"):
        options = {"compression": "gzip"} if fmt == "tsv.gz" else {}
        out.write.mode("errorifexists").csv(path, sep="\t", header=True, emptyValue="", nullValue="", **options)
    else:
        raise ValueError(f"Unknown result format '{fmt}'.")


def file_parts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path below root, size_bytes, sha256, content) of every file under a folder. The part files of a table folder all have its path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    # a table folder that Spark wrote has random part names: name it by its folder
    below = F.regexp_replace(F.substring_index("path", marker, -1), "/part-[^/]*$", "")
    return files.select(
        below.alias("path"), F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), "content",
    )


def _combined(parts: DataFrame, digest: str) -> DataFrame:
    """One row per path: total size, and the digest of the only part, or of all parts' digests in order. Part names are random, so
    parts count as a set; a folder has one row per part, each of 64 characters."""
    every = F.array_sort(F.collect_list(digest))
    return parts.groupBy("path").agg(F.sum("size_bytes").alias("size_bytes"), F.when(F.count(F.lit(1)) == 1, F.max(digest)).otherwise(F.sha2(F.array_join(every, ""), 256)).alias(digest))


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path below root, size_bytes, sha256) of every file or table folder under a folder."""
    return _combined(file_parts(spark, root, pattern).drop("content"), "sha256")


def audit_files(manifest: DataFrame, root: str, pattern: str = "*") -> DataFrame:
    """Declared (path, size_bytes, sha256) against what is on storage."""
    seen = file_digests(manifest.sparkSession, root, pattern).alias("s")
    joined = manifest.alias("m").join(seen, F.col("m.path") == F.col("s.path"), "left")
    status = (
        F.when(F.col("s.path").isNull(), "MISSING")
        .when(F.col("m.size_bytes") != F.col("s.size_bytes"), "SIZE_DRIFT")
        .when(F.col("m.sha256") != F.col("s.sha256"), "CHECKSUM_DRIFT")
        .otherwise("OK")
    )
    return joined.select("m.path", status.alias("status"))


@F.pandas_udf(T.StringType())
def _canonical(text: pd.Series) -> pd.Series:
    """JSON documents with sorted keys and no blanks."""
    return text.map(lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))


def compare_results(contract: DataFrame, left_root: str, right_root: str) -> DataFrame:
    """`contract` is (path, comparison) with comparison sha256 or canonical_json."""
    spark = contract.sparkSession

    def digest(root: str, name: str) -> DataFrame:
        files = file_parts(spark, root).join(contract, "path")
        canonical = F.sha2(_canonical(F.col("content").cast("string")), 256)
        own = files.select("path", "size_bytes", F.when(F.col("comparison") == "canonical_json", canonical).otherwise(F.col("sha256")).alias(name))
        return _combined(own, name).drop("size_bytes")

    both = contract.join(digest(left_root, "left_sha256"), "path", "left").join(digest(right_root, "right_sha256"), "path", "left")
    status = (
        F.when(F.col("left_sha256").isNull() | F.col("right_sha256").isNull(), "MISSING")
        .when(F.col("left_sha256") == F.col("right_sha256"), "MATCH")
        .otherwise("MISMATCH")
    )
    return both.withColumn("status", status)

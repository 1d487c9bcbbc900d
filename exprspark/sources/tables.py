"""Delimited tables: line scans, header-driven reads, wide/long reshapes and typed small formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exprspark.functions.text import blank, numeric, trim_columns

BOM = "﻿"


class SourceError(ValueError):
    """An input file breaks its declared layout."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, text) of a text file, gzip by suffix, or of the files of a folder one after the other by path. Every
    file block numbers its own lines; block totals (one row per block) give the offsets, so large files stay splittable."""
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )
    blocks = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = lines.join(offsets, "block").select(
        (F.col("offset") + F.col("row") - F.col("first") + 1).alias("line_number"), "text",
        ((F.col("block.start") == 0) & (F.col("row") == F.col("first"))).alias("opening"),
    )
    head = F.when(F.col("opening"), F.regexp_replace("text", f"^{BOM}", "")).otherwise(F.col("text"))
    return numbered.select("line_number", head.alias("text"))


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Tab if the first line has one, else comma if it has one, else by file suffix."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    if "\t" in line:
        return "\t"
    if "," in line:
        return ","
    stem = path[:-3] if path.lower().endswith(".gz") else path
    return "," if stem.lower().endswith(".csv") else "\t"


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Every column as text, header names kept, byte-order mark dropped."""
    delimiter = delimiter or detect_delimiter(spark, path)
    df = spark.read.csv(path, sep=delimiter, header=True, inferSchema=False, encoding="UTF-8")
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def matrix_long(wide: DataFrame, orientation: str, id_column: str) -> DataFrame:
    """Wide matrix to (feature_id, sample_id, value); values keep the type they came with."""
    other = [c for c in wide.columns if c != id_column]
    row, column = (
        ("feature_id", "sample_id") if orientation == "features_by_samples" else ("sample_id", "feature_id")
    )
    return wide.unpivot([id_column], other, column, "value").select(
        (F.trim(id_column) if dict(wide.dtypes)[id_column] == "string" else F.col(id_column)).alias(row),
        column,
        "value",
    ).select("feature_id", "sample_id", "value")


def matrix_wide(cells: DataFrame, orientation: str, columns: list[str] | None = None) -> DataFrame:
    """Long cells to a wide matrix for export; absent cells become 0. Pass the column names when
    they are known, else Spark reads them first."""
    row, column = (
        ("feature_id", "sample_id") if orientation == "features_by_samples" else ("sample_id", "feature_id")
    )
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first("value"))
    return wide.na.fill(0.0)


def read_metadata(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    df = read_table(spark, path)
    if key not in df.columns:
        raise SourceError(f"Sample metadata must contain {key}.")
    return key_first(df, key)


def key_first(meta: DataFrame, key: str) -> DataFrame:
    """Key renamed to sample_id and moved first, other columns in their order, blanks as ''."""
    rest = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in meta.columns if c != key]
    return meta.select(F.trim(F.col(f"`{key}`").cast("string")).alias("sample_id"), *rest)


def align_metadata(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """Metadata rows of the samples that the matrix has."""
    return meta.join(cells.select("sample_id").distinct(), "sample_id", "left_semi")


def check_gene_list(rows: DataFrame) -> DataFrame:
    """Entries of one gene list with request counts; a repeated id must repeat its weight."""
    unexpected = set(rows.columns) - {"gene_id", "weight"}
    if "gene_id" not in rows.columns or unexpected:
        raise SourceError("A gene list has a gene_id column and optionally a weight column.")
    weight = numeric(F.col("weight").cast("string")) if "weight" in rows.columns else F.lit(None).cast("double")
    weighted = "weight" in rows.columns
    return (
        rows.select(F.trim(F.col("gene_id").cast("string")).alias("identifier"), weight.alias("weight"))
        .groupBy("identifier")
        .agg(
            F.count(F.lit(1)).alias("requested"),
            F.first("weight", ignorenulls=True).alias("weight"),
            (F.count_distinct("weight") > 1).alias("conflicting"),
            (F.lit(weighted) & (F.count("weight") < F.count(F.lit(1)))).alias("invalid_weight"),
        )
    )


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    checked = check_gene_list(read_table(spark, path, "\t"))
    bad = checked.where("conflicting or invalid_weight or identifier = ''").select("identifier").first()
    if bad is not None:
        raise SourceError(f"Gene list row '{bad[0]}' is blank, lacks a weight or repeats with another weight.")
    if checked.isEmpty():
        raise SourceError("The gene list has no genes.")
    return checked.select("identifier", "weight", "requested")


def parse_gmt(lines: DataFrame) -> DataFrame:
    """(set_id, description, identifier, requested) from GMT text lines."""
    fields = F.split("text", "\t")
    return (
        lines.where(F.trim("text") != "")
        .select(
            F.trim(fields[0]).alias("set_id"),
            F.trim(F.get(fields, F.lit(1))).alias("description"),
            F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))).alias("members"),
        )
        # a line is split before its members become rows, not once for each of them
        .select("set_id", "description", F.explode("members").alias("identifier"))
        .select("set_id", "description", F.trim("identifier").alias("identifier"))
        .groupBy("set_id", "description", "identifier")
        .agg(F.count(F.lit(1)).alias("requested"))
    )


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    names = lines.where(F.trim("text") != "").select(
        F.trim(F.split("text", "\t")[0]).alias("set_id"), F.size(F.split("text", "\t")).alias("width")
    )
    bad = names.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("w")).where("n > 1 or w < 3")
    row = bad.first()
    if row is not None:
        raise SourceError(f"GMT set '{row[0]}' is repeated or has no genes.")
    return parse_gmt(lines)


# Columns every assignment table of the study type must have.
ASSIGNMENT_COLUMNS = {
    "paired_condition": ["measurement_id", "biological_sample_id", "prepared_dataset_id", "include", "condition", "run"],
    "precision": ["measurement_id", "biological_sample_id", "replicate_id", "include"],
    "input_levels": ["measurement_id", "biological_sample_id", "input_level", "run", "include"],
}


def read_assignments(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    df = read_table(spark, path, "\t")
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SourceError("Assignment table is missing columns: " + ", ".join(missing))
    return trim_columns(df)


def fraction_findings(wide: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of an external composition table that break its contract: value outside [0, 1], row sum
    off 1 by more than 0.02, repeated sample, sample missing from or unknown to the dataset."""
    long = fractions_long(wide)
    per_sample = long.groupBy("sample_id").agg(
        F.sum("value").alias("total"),
        F.max((F.col("value").isNull() | (F.col("value") < 0) | (F.col("value") > 1)).cast("int")).alias("outside"),
        (F.count(F.lit(1)) > F.count_distinct("cell_type_id")).alias("repeated"),
    )
    both = per_sample.join(samples.select("sample_id", F.lit(True).alias("known")), "sample_id", "full_outer")
    problem = F.array_compact(
        F.array(
            F.when(F.col("total").isNull() & F.col("outside").isNull(), "MISSING_SAMPLE"),
            F.when(F.col("known").isNull(), "UNEXPECTED_SAMPLE"),
            F.when(F.col("outside") == 1, "VALUE_OUTSIDE_UNIT_INTERVAL"),
            F.when(F.abs(F.col("total") - 1) > 0.02, "SUM_NOT_ONE"),
            F.when(F.col("repeated"), "DUPLICATE_SAMPLE"),
        )
    )
    return both.select("sample_id", F.explode(problem).alias("code"))


# Columns an external composition table may carry beside its populations.
DIAGNOSTIC_COLUMNS = ["p-value", "p.value", "correlation", "rmse", "absolute score (sig.score)"]


def fractions_long(wide: DataFrame) -> DataFrame:
    first = wide.columns[0]
    if first.strip().lower() != "mixture":
        raise SourceError("The first column of a composition table must be 'Mixture'.")
    kept = [c for c in wide.columns[1:] if c.strip().lower() not in DIAGNOSTIC_COLUMNS]
    if not kept:
        raise SourceError("The composition table has no population columns.")
    text = wide.select(F.trim(F.col(f"`{first}`").cast("string")).alias("sample_id"),
                       *[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in kept])
    return text.unpivot(["sample_id"], [c.strip() for c in kept], "cell_type_id", "text").select(
        "sample_id", "cell_type_id", numeric(F.col("text")).alias("value")
    )


def read_fractions(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    wide = read_table(spark, path)
    bad = fraction_findings(wide, samples).first()
    if bad is not None:
        raise SourceError(f"Composition table: {bad['code']} for '{bad['sample_id']}'.")
    return fractions_long(wide)


def truth_findings(truth: DataFrame, classes: list[str]) -> DataFrame:
    """One row of checks over a sealed truth table."""
    return truth.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) > F.count_distinct(F.trim("sample_id"))).alias("duplicate_ids"),
        (F.count_if(blank(F.col("sample_id"))) > 0).alias("blank_ids"),
        ((F.count_if(~F.trim("response").isin(classes)) == 0)
         & (F.count_distinct(F.trim("response")) == len(classes))).alias("classes_match"),
    )


def read_truth(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    truth = read_table(spark, path, "\t")
    if truth.columns != ["sample_id", "response"]:
        raise SourceError("Sealed truth must have exactly sample_id and response columns.")
    found = truth_findings(truth, classes).first()
    if found["rows"] == 0 or found["duplicate_ids"] or found["blank_ids"] or not found["classes_match"]:
        raise SourceError("Sealed truth identifiers must be unique and its classes must match the endpoint.")
    return trim_columns(truth)

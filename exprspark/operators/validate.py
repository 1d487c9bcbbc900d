"""Data-quality checks as rows: (severity, code, message, location, line_number, column_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.text import blank, is_missing, numeric

FINDING = ["severity", "code", "message", "location", "line_number", "column_index"]


def _finding(df: DataFrame, code: str, message: Column | str, location: Column, line: Column, column: Column | None = None) -> DataFrame:
    return df.select(
        F.lit("ERROR").alias("severity"),
        F.lit(code).alias("code"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        location.alias("location"),
        line.cast("bigint").alias("line_number"),
        (column if column is not None else F.lit(0)).cast("bigint").alias("column_index"),
    )


def finding(df: DataFrame, code: str, subject: Column | str = "", severity: str = "ERROR") -> DataFrame:
    """(severity, code, subject) rows."""
    column = subject if isinstance(subject, Column) else F.lit(subject)
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), column.alias("subject"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_layout(lines: DataFrame, delimiter: str, id_column: str) -> DataFrame:
    """Header and row-width findings over numbered text lines. The header line is one row; it is
    attached to the others as a one-row side."""
    fields = F.split("text", delimiter)
    header = lines.where("line_number = 1").select(fields.alias("names"), F.size(fields).alias("width"))
    names = header.select(F.explode("names").alias("name"))
    repeated = names.groupBy("name").count().where("count > 1")
    parts = [
        _finding(repeated.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "MATRIX_DUPLICATE_COLUMN",
                 "The header contains duplicate columns.", F.lit(None).cast("string"), F.lit(1)),
        _finding(header.where(~F.array_contains("names", id_column)), "MATRIX_ID_COLUMN_MISSING",
                 f"Required identifier column '{id_column}' was not found.", F.lit(None).cast("string"), F.lit(1)),
    ]
    rows = lines.where("line_number > 1").select("line_number", F.size(fields).alias("n")).crossJoin(
        F.broadcast(header.select("width"))).where("n <> width")
    parts.append(_finding(
        rows, "MATRIX_ROW_WIDTH",
        F.format_string("Matrix row %d has %d fields; expected %d.", "line_number", "n", "width"),
        F.concat(F.lit("matrix:"), F.col("line_number")), F.col("line_number")))
    return union_all(parts)


def repeats(rows: DataFrame, key: str, line: str = "line_number") -> DataFrame:
    """Second and later rows of every non-blank key. Each key's first line is a min, so a key that
    fills the table is never sorted in one task."""
    first = rows.groupBy(key).agg(F.min(line).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first, key).where(F.col(line) > F.col("_first")).drop("_first", "_n")


def check_ids(rows: DataFrame, key: str, kind: str = "feature") -> DataFrame:
    """Blank and repeated matrix identifiers; `rows` has one row per matrix line."""
    text = rows.withColumn(key, F.trim(F.col(key)))
    location = F.concat(F.lit("matrix:"), F.col("line_number"))
    again = repeats(text.where(~blank(F.col(key))), key)
    code = "MATRIX_DUPLICATE_FEATURE" if kind == "feature" else "MATRIX_DUPLICATE_SAMPLE"
    return _finding(text.where(blank(F.col(key))), "MATRIX_BLANK_IDENTIFIER", "A matrix row has a blank identifier.",
                    location, F.col("line_number")).unionByName(
        _finding(again, code, F.format_string(f"{kind.capitalize()} identifier '%s' occurs more than once.", key),
                 location, F.col("line_number")))


def cell_flags(value: Column, raw_counts: bool) -> dict[str, Column]:
    """Named conditions on one text cell."""
    text = F.trim(F.coalesce(value, F.lit("")))
    number = numeric(text)
    missing = text == ""
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    flags = {
        "MATRIX_MISSING_VALUE": missing,
        "MATRIX_NON_NUMERIC": ~missing & number.isNull(),
        "MATRIX_NON_FINITE": number.isNotNull() & ~finite,
    }
    if raw_counts:
        flags["COUNT_MATRIX_NEGATIVE"] = F.coalesce(number < 0, F.lit(False))
        flags["COUNT_MATRIX_NON_INTEGER"] = finite & (F.floor(number) != number)
    return flags


# Fixed texts of the cell findings.
CELL_MESSAGES = {
    "MATRIX_MISSING_VALUE": "Expression matrices cannot contain missing values.",
    "MATRIX_NON_NUMERIC": "The value is not numeric.",
    "MATRIX_NON_FINITE": "Expression values must be finite.",
    "COUNT_MATRIX_NEGATIVE": "Raw counts cannot be negative.",
    "COUNT_MATRIX_NON_INTEGER": "Raw counts must be integer-like values.",
}


def check_cells(cells: DataFrame, raw_counts: bool = True) -> DataFrame:
    """Findings per cell in one scan; cells carry line_number, column_index, column and text value."""
    flags = cell_flags(F.col("value").cast("string"), raw_counts)
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in flags.items()]))
    hit = cells.withColumn("code", F.explode(codes))
    messages = F.create_map(*[F.lit(x) for kv in CELL_MESSAGES.items() for x in kv])
    return hit.select(
        F.lit("ERROR").alias("severity"), "code", messages[F.col("code")].alias("message"),
        F.concat_ws(":", F.lit("matrix"), F.col("line_number").cast("string"), F.col("column")).alias("location"),
        F.col("line_number").cast("bigint"), F.col("column_index").cast("bigint"),
    )


def cell_counters(cells: DataFrame, raw_counts: bool = True) -> DataFrame:
    """All counters of the cell checks in one aggregation."""
    f = cell_flags(F.col("value").cast("string"), raw_counts)
    no = F.lit(False)
    return cells.agg(
        F.count(F.lit(1)).alias("data_cell_count"),
        F.count_if(f["MATRIX_MISSING_VALUE"]).alias("missing_cell_count"),
        F.count_if(f["MATRIX_NON_NUMERIC"] | f["MATRIX_NON_FINITE"]).alias("non_numeric_cell_count"),
        F.count_if(f.get("COUNT_MATRIX_NEGATIVE", no)).alias("negative_cell_count"),
        F.count_if(f.get("COUNT_MATRIX_NON_INTEGER", no)).alias("non_integer_cell_count"),
    )


def check_metadata(meta: DataFrame) -> DataFrame:
    """Blank and repeated samples; rows carry line_number and sample_id."""
    location = F.concat(F.lit("metadata:"), F.col("line_number"))
    text = meta.withColumn("sample_id", F.trim("sample_id"))
    again = repeats(text.where(~blank(F.col("sample_id"))), "sample_id")
    return _finding(text.where(blank(F.col("sample_id"))), "METADATA_BLANK_SAMPLE", "A metadata row has a blank sample identifier.",
                    location, F.col("line_number")).unionByName(
        _finding(again, "METADATA_DUPLICATE_SAMPLE",
                 F.format_string("Sample identifier '%s' occurs more than once in metadata.", "sample_id"),
                 location, F.col("line_number")))


def id_mismatch(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples that only the matrix or only the metadata has."""
    left, right = cells.select("sample_id").distinct(), meta.select("sample_id").distinct()
    return left.join(right, "sample_id", "left_anti").select("sample_id", F.lit("matrix_only").alias("side")).unionByName(
        right.join(left, "sample_id", "left_anti").select("sample_id", F.lit("metadata_only").alias("side")))


def collect_findings(findings: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(first `limit` findings in file order, suppressed count per code)."""
    kept = findings.orderBy("line_number", "column_index", "code").limit(limit)
    counts = findings.groupBy("code").agg(F.count(F.lit(1)).alias("total"))
    shown = kept.groupBy("code").agg(F.count(F.lit(1)).alias("shown"))
    rest = F.col("total") - F.coalesce("shown", F.lit(0))
    return kept, counts.join(shown, "code", "left").select("code", rest.alias("suppressed")).where("suppressed > 0")


def validation_report(cells: DataFrame, meta: DataFrame, findings: DataFrame, raw_counts: bool = True) -> DataFrame:
    """One summary row of a matrix/metadata pair and its status."""
    shape = cells.agg(F.count_distinct("sample_id").alias("sample_count"), F.count_distinct("feature_id").alias("feature_count"))
    sides = id_mismatch(cells, meta).agg(
        F.count_if(F.col("side") == "matrix_only").alias("matrix_only"),
        F.count_if(F.col("side") == "metadata_only").alias("metadata_only"))
    errors = findings.where("severity = 'ERROR'").agg(F.count(F.lit(1)).alias("error_count"))
    row = shape.crossJoin(cell_counters(cells, raw_counts)).crossJoin(sides).crossJoin(errors)  # one row each
    bad = (F.col("error_count") > 0) | (F.col("matrix_only") > 0) | (F.col("metadata_only") > 0)
    return row.withColumn("status", F.when(bad, "INVALID").otherwise("VALID"))


def preview_rows(table: DataFrame, key: str = "line_number", n: int = 5) -> DataFrame:
    return table.orderBy(key).limit(n)


def _distinct_values(meta: DataFrame, key: str) -> DataFrame:
    """(variable, value, n): one row per distinct value, so later steps see values, not samples."""
    columns = [c for c in meta.columns if c != key]
    text = meta.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in columns])
    return text.unpivot([], columns, "variable", "value").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_variables(meta: DataFrame, key: str = "sample_id") -> DataFrame:
    """Kind, missing and distinct counts of every metadata column. A column is numeric when every
    present value is a number."""
    missing = is_missing(F.col("value"))
    per = _distinct_values(meta, key).groupBy("variable").agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count_if(~missing).alias("unique_count"),
        F.coalesce(F.bool_and(F.when(~missing, numeric(F.col("value")).isNotNull())), F.lit(False)).alias("numeric"),
    )
    return per.select("variable", F.when(F.col("numeric"), "numeric").otherwise("categorical").alias("kind"),
                      "missing_count", "unique_count")


def variable_levels(meta: DataFrame, key: str = "sample_id") -> DataFrame:
    """Levels as rows, for categorical columns and for numeric columns with exactly two values."""
    listed = profile_variables(meta, key).where("kind = 'categorical' or unique_count = 2").select("variable")
    values = _distinct_values(meta, key).where(~is_missing(F.col("value")))
    return values.join(listed, "variable", "left_semi").select("variable", F.col("value").alias("level"), "n")


def method_capability(assays: DataFrame, methods: DataFrame, organism: str, has_symbols: bool) -> DataFrame:
    """Which declared assay suits which method, and what blocks the method otherwise.
    assays: (assay, scale, value_type, feature_level); methods: (method, organism, assay, scales,
    value_types, status, mode), one row per accepted assay."""
    match = (
        (F.col("m.assay") == F.col("a.assay")) & F.array_contains("m.scales", F.col("a.scale"))
        & F.array_contains("m.value_types", F.col("a.value_type")) & (F.col("a.feature_level") == "gene")
    )
    joined = methods.alias("m").join(assays.alias("a"), match, "left")
    per = joined.groupBy("m.method", "m.organism", "m.status", "m.mode").agg(
        F.array_sort(F.collect_set("a.assay")).alias("compatible_assays"),
        F.array_sort(F.collect_set("m.assay")).alias("wanted"))
    fits = F.col("organism") == organism
    base = [
        F.when(~fits, F.concat(F.lit("organism is not "), "organism")),
        F.when(F.lit(not has_symbols), "no gene symbol column"),
        F.when(F.size("compatible_assays") == 0, F.concat(F.lit("no compatible assay; needs "), F.array_join("wanted", ", "))),
        F.when(F.col("status") == "license_blocked", "upstream licence acceptance is required")
        .when(F.col("status") != "available", "runner is not implemented"),
    ]
    reasons = F.array_compact(F.array(*base))
    external = (F.col("mode") == "external_import") & (F.size(reasons) == 0)
    usable = (F.size("compatible_assays") > 0) & F.lit(has_symbols) & fits & (
        (F.col("mode") == "native") | (F.col("status") == "available"))
    return per.select(
        "method", "compatible_assays", usable.alias("configurable"),
        ((F.col("mode") == "native") & (F.col("status") == "available")).alias("executable"),
        F.when(external, F.array(F.lit("external import only"))).otherwise(reasons).alias("blocked_reasons"))


# Tests that accept each assay, the first being the default.
COUNT_METHODS = ["deseq2", "edger_ql", "limma_voom"]
CONTINUOUS_METHODS = ["limma"]


def resolve_method(assay: str, requested: str) -> str:
    allowed = COUNT_METHODS if assay == "raw_counts" else CONTINUOUS_METHODS
    method = allowed[0] if requested == "auto" else requested
    if method not in allowed:
        raise ValueError(f"Method '{method}' does not fit assay '{assay}'; use one of {', '.join(sorted(allowed))}.")
    return method

"""Design matrices: encoding, normal equations, rank and replication checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprspark.functions.text import is_missing, numeric
from exprspark.operators.validate import finding, profile_variables, union_all

MAX_COLUMNS = 2000


@dataclass
class Design:
    """Terms in model order. Terms in `categorical`, and every non-numeric one, become dummies
    against their reference level (the first level unless given)."""

    terms: list[str]
    categorical: list[str] = field(default_factory=list)
    references: dict[str, str] = field(default_factory=dict)
    interactions: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Encoded:
    names: list[str]
    rows: DataFrame  # sample_id, x array<double>
    levels: dict[str, list[str]]

    @property
    def width(self) -> int:
        return len(self.names)


def formula(design: Design) -> str:
    inside = {name for pair in design.interactions for name in pair}
    parts = [t for t in dict.fromkeys(design.terms) if t not in inside]
    return "~ " + " + ".join(parts + [f"{a} * {b}" for a, b in design.interactions])


def encode(meta: DataFrame, design: Design) -> Encoded:
    """Intercept, centred numbers, dummies and pairwise products, one array per sample."""
    terms = list(dict.fromkeys(design.terms))
    kinds = {r["variable"]: r for r in profile_variables(meta.select("sample_id", *terms)).collect()} if terms else {}
    text = [t for t in terms if t in design.categorical or kinds[t]["kind"] == "categorical"]
    if sum(kinds[t]["unique_count"] for t in text) > MAX_COLUMNS:
        raise ValueError("The design has more levels than model columns allow; absorb the block instead.")
    means = meta.agg(*[F.avg(numeric(F.col(t).cast("string"))) for t in terms if t not in text]).first() if len(text) < len(terms) else []
    mean_of = dict(zip([t for t in terms if t not in text], means))
    levels: dict[str, list[str]] = {}
    for t in text:
        levels[t] = sorted(r[0] for r in meta.select(F.trim(F.col(t).cast("string"))).distinct().collect())  # <= MAX_COLUMNS
    encoded: dict[str, list[tuple[str, Column]]] = {}
    for t in terms:
        if t in text:
            reference = design.references.get(t, levels[t][0])
            if reference not in levels[t]:
                raise ValueError(f"Reference level '{reference}' is absent from '{t}'.")
            levels[t] = [reference] + [v for v in levels[t] if v != reference]
            column = F.trim(F.col(t).cast("string"))
            encoded[t] = [(f"{t}[{v}]", (column == v).cast("double")) for v in levels[t][1:]]
        else:
            encoded[t] = [(t, numeric(F.col(t).cast("string")) - F.lit(mean_of[t]))]
    columns = [("Intercept", F.lit(1.0))] + [c for t in terms for c in encoded[t]]
    for left, right in design.interactions:
        columns += [(f"{a}:{b}", x * y) for a, x in encoded[left] for b, y in encoded[right]]
    return Encoded([n for n, _ in columns], meta.select("sample_id", F.array(*[c for _, c in columns]).alias("x")), levels)


def design_matrix(meta: DataFrame, design: Design) -> DataFrame:
    """(sample_id, term, x) in long form."""
    enc = encode(meta, design)
    names = F.array(*[F.lit(n) for n in enc.names])
    return enc.rows.select("sample_id", F.posexplode("x").alias("_p", "x")).select("sample_id", F.get(names, F.col("_p")).alias("term"), "x")


def contrast_weights(enc: Encoded, variable: str, numerator: str, denominator: str) -> np.ndarray:
    """Coefficient weights of numerator minus denominator with every other variable at its
    reference (numbers at their mean), so interactions with it drop out."""
    weights = np.zeros(enc.width)
    for level, sign in ((numerator, 1.0), (denominator, -1.0)):
        if level not in enc.levels[variable]:
            raise ValueError(f"Contrast level '{level}' is absent from '{variable}'.")
        name = f"{variable}[{level}]"
        if name in enc.names:
            weights[enc.names.index(name)] += sign
    if not weights.any():
        raise ValueError("The contrast has no weight on any model column.")
    return weights


def cross_products(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum over rows of z z' for an array column of `width` numbers. Every partition adds its rows
    up as one small matrix; those matrices are summed by Spark."""
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} model columns are more than {MAX_COLUMNS}; absorb the block instead.")

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = np.stack(batch["z"].to_numpy()).astype(float)
                total += z.T @ z
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    parts = rows.select(F.col(column).alias("z")).mapInPandas(partial, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[sums["i"], sums["j"]] = sums["v"]
    return out


def matrix_rank(gram: np.ndarray) -> int:
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values = np.linalg.eigvalsh(gram / np.outer(scale, scale))
    return int((values > max(values.max(), 0) * 1e-10).sum())


def design_rank(meta: DataFrame, design: Design) -> tuple[int, int]:
    enc = encode(meta, design)
    return matrix_rank(cross_products(enc.rows, "x", enc.width)), enc.width


def validate_design(meta: DataFrame, design: Design, variable: str, numerator: str, denominator: str, minimum_samples: int = 2) -> DataFrame:
    """Findings on missing values, single-valued terms, contrast replication and balance, rank and
    saturation: (severity, code, subject)."""
    spark = meta.sparkSession
    absent = [t for t in design.terms if t not in meta.columns]
    none = spark.range(1)
    parts = [finding(none, "DESIGN.UNKNOWN_VARIABLE", t) for t in absent]
    terms = [t for t in dict.fromkeys(design.terms) if t in meta.columns]
    profile = profile_variables(meta.select("sample_id", *terms))
    parts.append(finding(profile.where("missing_count > 0"), "DESIGN.MISSING_VALUES", F.col("variable")))
    parts.append(finding(profile.where("unique_count < 2"), "DESIGN.SINGLE_VALUE", F.col("variable")))
    counts = meta.agg(*[F.count_if(F.col(variable).cast("string") == v).alias(n) for v, n in ((numerator, "a"), (denominator, "b"))])
    for name, level in (("a", numerator), ("b", denominator)):
        parts.append(finding(counts.where(F.col(name) == 0), "DESIGN.CONTRAST_LEVEL_ABSENT", level))
        parts.append(finding(counts.where(F.col(name).between(1, minimum_samples - 1)), "DESIGN.REPLICATION_TOO_LOW", level))
    ratio = F.least("a", "b") / F.greatest("a", "b")
    parts.append(finding(counts.where((F.least("a", "b") > 0) & (ratio < 0.25)), "DESIGN.IMBALANCED", severity="WARNING"))
    usable = profile.where("missing_count = 0 and unique_count >= 2").select("variable").collect()  # model terms
    names = [t for t in terms if t in {r[0] for r in usable}]
    kept = Design(names, design.categorical, design.references, [p for p in design.interactions if set(p) <= set(names)])
    rank, width = design_rank(meta, kept)
    samples = meta.count()
    if rank < width:
        parts.append(finding(none, "DESIGN.RANK_DEFICIENT", f"{rank} of {width}"))
    if width >= samples:
        parts.append(finding(none, "DESIGN.SATURATED", severity="WARNING"))
    return union_all(parts)


def design_cells(meta: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Samples per combination of the categorical terms."""
    kinds = {r["variable"]: r["kind"] for r in profile_variables(meta.select("sample_id", *terms)).collect()}
    kept = [t for t in terms if kinds[t] == "categorical"]
    return meta.groupBy(*kept).agg(F.count(F.lit(1)).alias("sample_count"))


def check_association(meta: DataFrame, phenotype: str, covariates: list[str], block: str | None = None) -> DataFrame:
    """Findings of an association design: missing values, groups below two, rank, residual df."""
    terms = [*covariates, *([block] if block else []), phenotype]
    missing = meta.select(*[is_missing(F.col(t).cast("string")).alias(t) for t in terms]).agg(*[F.count_if(F.col(t)).alias(t) for t in terms])
    kinds = {r["variable"]: r["kind"] for r in profile_variables(meta.select("sample_id", *terms)).collect()}
    none = meta.sparkSession.range(1)
    parts = [finding(missing.where(F.col(t) > 0), "ASSOCIATION.MISSING_VALUES", t) for t in terms]
    if kinds[phenotype] == "categorical":
        groups = meta.groupBy(F.col(phenotype).cast("string").alias("level")).count()
        parts.append(finding(groups.where("count < 2"), "ASSOCIATION.GROUP_TOO_SMALL", F.col("level")))
        parts.append(finding(groups.agg(F.count(F.lit(1)).alias("k")).where("k < 2"), "ASSOCIATION.SINGLE_GROUP", phenotype))
    rank, width = design_rank(meta, Design(terms, categorical=[block] if block else []))
    if rank < width:
        parts.append(finding(none, "ASSOCIATION.RANK_DEFICIENT", f"{rank} of {width}"))
    if width >= meta.count():
        parts.append(finding(none, "ASSOCIATION.NO_RESIDUAL_DF"))
    return union_all(parts)

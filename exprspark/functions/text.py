"""Text rules shared by metadata, identifiers and assignment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that count as missing metadata, compared in lower case.
MISSING_TOKENS = ["", "na", "nan", "null", "none"]
# Accepted spellings of the include flag.
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]
# Fixed pattern: a human gene accession is ENSG and eleven digits, optionally a version.
GENE_PATTERN = "^ENSG[0-9]{11}$"
GENE_VERSION_PATTERN = "^ENSG[0-9]{11}\\.[0-9]+$"


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def is_missing(column: Column) -> Column:
    return F.lower(F.coalesce(F.trim(column), F.lit(""))).isin(MISSING_TOKENS)


def parse_flag(column: Column) -> Column:
    """true / false, or NULL when the cell is neither."""
    word = F.lower(F.trim(column))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def normalise_identifier(column: Column, identifier_type: str) -> Column:
    text = F.trim(column)
    if identifier_type == "ensembl_gene_id":
        return F.upper(F.regexp_replace(text, "\\.\\d+$", ""))
    return F.upper(text) if identifier_type == "gene_symbol" else text


def numeric(column: Column) -> Column:
    """Number in a text cell, or NULL when it is not one."""
    return F.trim(column).try_cast("double")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def trim_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in df.columns])


def rounded(column: Column, digits: int = 6) -> Column:
    """Published precision; adding zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)

"""Identifier mapping, joins to annotation, and collapsing of several rows to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.ordering import largest_group, medians, one_row, spread_join
from exprspark.functions.text import GENE_PATTERN, GENE_VERSION_PATTERN, blank, normalise_identifier


def map_features(ids: DataFrame, id_type: str = "ensembl_gene_id", strip_version: bool = True) -> DataFrame:
    """(original_feature_id, feature_id, mapping_status)."""
    original = F.col("original_feature_id")
    if id_type != "ensembl_gene_id":
        return ids.select(original, original.alias("feature_id"), F.lit("unmapped").alias("mapping_status"))
    identity = original.rlike(GENE_PATTERN)
    stripped = original.rlike(GENE_VERSION_PATTERN) & F.lit(strip_version)
    return ids.select(
        original,
        F.when(~identity & stripped, F.substring_index(original, ".", 1)).otherwise(original).alias("feature_id"),
        F.when(identity, "mapped_identity").when(stripped, "mapped_version_stripped").otherwise("unmapped").alias("mapping_status"),
    )


def collapse_sum(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sum the cells of all original ids that map to one feature."""
    pairs = mapping.select(F.col("original_feature_id").alias("feature_id"), F.col("feature_id").alias("_to"))
    return spread_join(cells, pairs, ["feature_id"], "sample_id").groupBy(F.col("_to").alias("feature_id"), "sample_id").agg(
        F.sum("value").alias("value"))


def mapping_report(mapping: DataFrame) -> DataFrame:
    """One row per resulting feature: its status and how many input ids it took."""
    grouped = mapping.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("input_feature_count"), F.min("mapping_status").alias("first_status"))
    return grouped.select(
        "feature_id",
        F.when(F.col("feature_id").startswith("ENSG") & (F.length("feature_id") == 15), F.col("feature_id")).otherwise("").alias("ensembl_gene_id"),
        F.when(F.col("input_feature_count") > 1, "duplicate_aggregated_sum").otherwise(F.col("first_status")).alias("mapping_status"),
        "input_feature_count")


def duplicate_members(mapping: DataFrame) -> DataFrame:
    """Input ids that share a feature, as rows (one feature may have taken any number of them)."""
    sizes = mapping.groupBy("feature_id").agg(F.count(F.lit(1)).alias("input_feature_count")).where("input_feature_count > 1")
    return mapping.join(sizes, "feature_id").select(
        "feature_id", "original_feature_id", F.lit("sum").alias("resolution"), "input_feature_count")


def unmapped_features(mapping: DataFrame) -> DataFrame:
    return mapping.where("mapping_status = 'unmapped'").select(
        "original_feature_id", F.lit("No explicit mapping was available").alias("reason"))


def mapping_coverage(mapping: DataFrame) -> DataFrame:
    groups = mapping.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapping_status") != "unmapped").alias("mapped"))
    return groups.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.sum("mapped").alias("mapped_feature_count"),
        (F.sum("n") - F.sum("mapped")).alias("unmapped_feature_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_group_count"),
        (F.sum("mapped") / F.sum("n")).alias("mapping_coverage"))


def collapse_symbol(cells: DataFrame, feat: DataFrame, rule: str = "sum") -> DataFrame:
    """Cells by gene symbol; features without one are dropped. The mean rule divides by the number
    of features of the symbol, so absent cells count as zero."""
    named = feat.where(~blank(F.col("symbol"))).select("feature_id", F.trim("symbol").alias("symbol"))
    out = spread_join(cells, named, ["feature_id"], "sample_id").groupBy("symbol", "sample_id").agg(F.sum("value").alias("value"))
    if rule == "sum":
        return out
    present = cells.select("feature_id").distinct()
    sizes = named.join(present, "feature_id", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("_k"))
    return spread_join(out, sizes, ["symbol"], "sample_id").select("symbol", "sample_id", (F.col("value") / F.col("_k")).alias("value"))


def annotate_probes(probes: DataFrame, clusters: DataFrame, annotation: DataFrame) -> DataFrame:
    """Probe to cluster to gene, keeping probes that find neither."""
    joined = probes.join(clusters, "probe_id", "left").join(annotation, "cluster_id", "left")
    status = F.when(blank(F.col("gene_id")), "unmapped").otherwise("mapped")
    return joined.withColumn("mapping_status", status)


def median_absolute_deviation(cells: DataFrame, by: list[str], constant: float = 1.0) -> DataFrame:
    """Two passes: centre, then the median distance to it."""
    size = largest_group(cells, by)
    centre = medians(cells, by, "value", "_centre", size)
    away = cells.join(centre, by) if by else one_row(cells, centre)
    spread = medians(away.withColumn("_away", F.abs(F.col("value") - F.col("_centre"))), by, "_away", "mad", size)
    return spread.withColumn("mad", F.col("mad") * F.lit(constant))


def collapse_probe(cells: DataFrame, mapping: DataFrame, rule: str = "highest_mad") -> DataFrame:
    """Probe cells (feature_id = probe) to gene cells. Ties of the highest deviation go to the
    smallest probe id."""
    pairs = mapping.where("mapping_status = 'mapped'").select(F.col("probe_id").alias("feature_id"), "gene_id").distinct()
    if rule == "highest_mad":
        scored = median_absolute_deviation(cells, ["feature_id"]).join(pairs, "feature_id")
        best = scored.groupBy("gene_id").agg(F.min_by("feature_id", F.struct(-F.col("mad"), F.col("feature_id"))).alias("feature_id"))
        out = spread_join(cells, best, ["feature_id"], "sample_id")
        return out.select("gene_id", "sample_id", "value")
    joined = spread_join(cells, pairs, ["feature_id"], "sample_id")
    if rule == "median":
        return medians(joined, ["gene_id", "sample_id"], "value", "value")
    if rule == "mean":
        return joined.groupBy("gene_id", "sample_id").agg(F.avg("value").alias("value"))
    raise ValueError(f"Unknown aggregation rule '{rule}'.")


def gene_metadata(mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Per gene: first non-blank value of each column in sort order, and the number of its probes
    (which they are stays in the mapping rows)."""
    rows = mapping.where("mapping_status = 'mapped'")
    firsts = [F.coalesce(F.min(F.when(~blank(F.col(c)), F.col(c))), F.lit("")).alias(c) for c in columns]
    return rows.groupBy("gene_id").agg(*firsts, F.count_distinct("probe_id").alias("probe_count"))


def tx_to_gene(quant: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """Gene counts, TPM and TPM-weighted effective length per sample. A sample with no TPM for the
    gene takes the geometric mean of the gene's lengths over its other samples, or of its plain
    transcript mean when the gene has no TPM anywhere."""
    pairs = tx2gene.select("transcript_id", "gene_id")
    per = spread_join(quant, pairs, ["transcript_id"], "sample_id").groupBy("gene_id", "sample_id").agg(
        F.sum("counts").alias("counts"), F.sum("tpm").alias("tpm"),
        F.sum(F.col("tpm") * F.col("length")).alias("_weighted"), F.avg("length").alias("_plain"))
    own = F.when(F.col("tpm") > 0, F.col("_weighted") / F.col("tpm"))
    genes = per.groupBy("gene_id").agg(F.exp(F.avg(F.log(own))).alias("_other"), F.avg("_plain").alias("_all"))
    return spread_join(per, genes, ["gene_id"], "sample_id").select(
        "gene_id", "sample_id", "counts", "tpm", F.coalesce(own, "_other", "_all").alias("length"))


def set_counts(members: DataFrame) -> DataFrame:
    """Requested, distinct and repeated identifiers of every set."""
    distinct = members.groupBy("set_id", "identifier").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("set_id").agg(
        F.sum("n").alias("requested_identifier_count"), F.count(F.lit(1)).alias("unique_identifier_count"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_identifier_count"))


def map_signature(members: DataFrame, feat: DataFrame, id_type: str, column: str) -> DataFrame:
    """Status of every distinct set member against the feature table: mapped to one feature,
    missing, or ambiguous."""
    index = (
        feat.where(~blank(F.col(column))).select(normalise_identifier(F.col(column), id_type).alias("_key"), "feature_id")
        .groupBy("_key").agg(F.count_distinct("feature_id").alias("_matches"), F.min("feature_id").alias("feature_id"))
    )
    weight = [F.first("weight").alias("weight")] if "weight" in members.columns else []
    distinct = members.groupBy("set_id", "identifier").agg(F.count(F.lit(1)).alias("_n"), *weight)
    joined = distinct.withColumn("_key", normalise_identifier(F.col("identifier"), id_type)).join(index, "_key", "left")
    matches = F.coalesce("_matches", F.lit(0))
    status = F.when(matches == 1, "mapped").when(matches == 0, "missing").otherwise("ambiguous")
    return joined.select(
        "set_id", "identifier", status.alias("status"), F.when(matches == 1, F.col("feature_id")).alias("feature_id"),
        *(["weight"] if weight else []))


def signature_coverage(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("unique_identifier_count"),
        F.count_if(F.col("status") == "mapped").alias("mapped_identifier_count"),
        F.count_if(F.col("status") == "missing").alias("missing_identifier_count"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous_identifier_count"),
        (F.count_if(F.col("status") == "mapped") / F.count(F.lit(1))).alias("mapping_coverage"))


def reference_overlap(genes: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene, present) for a reference gene list."""
    seen = cells.select(F.col("feature_id").alias("gene")).distinct().withColumn("_seen", F.lit(True))
    return genes.distinct().join(seen, "gene", "left").select("gene", F.coalesce("_seen", F.lit(False)).alias("present"))


def overlap_gate(overlap: DataFrame, minimum: float) -> DataFrame:
    share = F.count_if("present") / F.count(F.lit(1))
    return overlap.agg(
        F.count(F.lit(1)).alias("reference_gene_count"), F.count_if("present").alias("overlap_gene_count"),
        share.alias("overlap_fraction"), (share >= minimum).alias("passed"))


def snapshot_selection(chosen: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(published rows of the chosen features, chosen ids that have no result)."""
    return results.join(chosen, "feature_id", "left_semi"), chosen.join(results, "feature_id", "left_anti")


def latest_per_key(df: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key, equal times by largest id: a max, not a sort of the group."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(tie))).alias("_row")
    return df.groupBy(*key).agg(newest).select(*key, "_row.*")

"""Annotation, quantification, sample-sheet and cohort inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprspark.sources.tables import SourceError


def _is_pattern(path: str) -> bool:
    return any(c in path for c in "*?[{")


def _reader(spark: SparkSession, pattern: str, suffix: str):
    """A folder is listed with all its subfolders by Spark jobs, a pattern one folder after another by the driver."""
    return spark.read if _is_pattern(pattern) else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")


def _first_file(spark: SparkSession, root: str, suffix: str) -> str | None:
    """Some file of a folder's tree, by descending into one branch after another until there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True)
    while files.hasNext():
        found = files.next().getPath()
        if found.getName().endswith(suffix) and not found.getName().startswith(("_", ".")):
            return found.toString()
    return None


def read_quantifications(spark: SparkSession, pattern: str, suffix: str = ".csv") -> DataFrame:
    """One transcript table per sample folder: (sample_id, transcript_id, length, tpm, counts).
    The sample is the name of the folder that holds the file. `pattern` names the files, or the folder that holds all samples; its files
    then end in `suffix` and carry one and the same header line."""
    reader = _reader(spark, pattern, suffix)
    if not _is_pattern(pattern):
        one = _first_file(spark, pattern, suffix)
        if one is None:
            raise SourceError(f"No quantification ends in '{suffix}'.")
        # columns by the header of one file; any other header is an error, not a wrong column
        reader = reader.schema(spark.read.csv(one, sep="\t", header=True).schema).option("enforceSchema", "false")
    raw = reader.csv(pattern, sep="\t", header=True)
    sample = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.select(
        F.url_decode(sample).alias("sample_id"),
        F.col("Name").alias("transcript_id"),
        F.col("EffectiveLength").cast("double").alias("length"),
        F.col("TPM").cast("double").alias("tpm"),
        F.col("NumReads").cast("double").alias("counts"),
    )


def read_mapping_statistics(spark: SparkSession, pattern: str, suffix: str = ".json") -> DataFrame:
    """(sample_id, num_processed, num_mapped) from one JSON document per sample folder. `pattern` names the files, or the folder that
    holds all samples; its files then end in `suffix`."""
    raw = _reader(spark, pattern, suffix).schema("num_processed BIGINT, num_mapped BIGINT").json(pattern, multiLine=True)
    sample = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    return raw.select(F.url_decode(sample).alias("sample_id"), "num_processed", "num_mapped")


def _attribute(name: str) -> Column:
    return F.regexp_extract("attributes", f'(?:^|[;\\s]){name}\\s+"([^"]*)"', 1)


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Distinct transcript records of an annotation, with the number of differing versions."""
    fields = F.split("text", "\t")
    rows = (
        lines.where(~F.col("text").startswith("#"))
        .select(fields.alias("f"))
        .where((F.size("f") == 9) & F.col("f")[2].isin("transcript", "exon"))
        .select(F.col("f")[0].alias("seqname"), F.col("f")[8].alias("attributes"))
    )
    gene_type = _attribute("gene_type")
    records = rows.select(
        _attribute("transcript_id").alias("transcript_id"),
        _attribute("gene_id").alias("gene_id"),
        _attribute("gene_name").alias("gene_name"),
        F.when(gene_type != "", gene_type).otherwise(_attribute("gene_biotype")).alias("gene_type"),
        "seqname",
    ).where("transcript_id <> '' and gene_id <> ''")
    record = F.struct("gene_id", "gene_name", "gene_type", "seqname")
    return (
        records.groupBy("transcript_id")
        .agg(F.min(record).alias("r"), (F.min(record) != F.max(record)).alias("conflicting"))
        .select("transcript_id", "r.*", "conflicting")
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    parsed = parse_gtf(spark.read.text(path).withColumnRenamed("value", "text"))
    bad = parsed.where("conflicting").first()
    if bad is not None:
        raise SourceError(f"The annotation disagrees for transcript {bad['transcript_id']}.")
    return parsed.drop("conflicting")


def read_fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").startswith(">"))
    return lines.select(F.regexp_extract("value", "^>\\s*(\\S+)", 1).alias("record_id"))


# Fixed pattern: ids safe to use in file names.
SAFE_ID = "^[A-Za-z0-9][A-Za-z0-9._-]*$"
# Fixed value: longest accepted sample sheet, in lanes.
MAX_LANE_ROWS = 10_000


def lane_findings(sheet: DataFrame, files: DataFrame, metadata_columns: list[str], max_rows: int | None = MAX_LANE_ROWS) -> DataFrame:
    """Contract breaks of a sequencing sample sheet: (code, subject). `files` is (role, name). An uploaded sheet has a
    largest length; with `max_rows` None the sheet is a table of any length."""
    rows = sheet.withColumn("lane_id", F.when(F.coalesce(F.trim("lane_id"), F.lit("")) == "", "lane_1").otherwise(F.trim("lane_id")))
    reads = rows.select(
        "sample_id",
        F.explode(
            F.array(
                F.struct(F.lit("fastq_r1").alias("role"), F.col("read1").alias("name")),
                F.struct(F.lit("fastq_r2").alias("role"), F.col("read2").alias("name")),
            )
        ).alias("r"),
    ).select("sample_id", "r.*").where("coalesce(name, '') <> ''")
    known = files.select("role", "name").distinct()
    layout = F.when(F.coalesce("read2", F.lit("")) == "", "single_end").otherwise("paired_end")
    drift = rows.select("sample_id", F.struct(*metadata_columns).alias("meta") if metadata_columns else F.lit(1).alias("meta"))
    parts = [
        rows.where(~F.col("sample_id").rlike(SAFE_ID)).select(F.lit("UNSAFE_SAMPLE").alias("code"), F.col("sample_id").alias("subject")),
        reads.join(known, ["role", "name"], "left_anti").select(F.lit("UNKNOWN_READ_FILE").alias("code"), F.col("name").alias("subject")),
        reads.groupBy("name").count().where("count > 1").select(F.lit("READ_FILE_REUSED").alias("code"), F.col("name").alias("subject")),
        rows.groupBy("sample_id", "lane_id").count().where("count > 1").select(
            F.lit("DUPLICATE_LANE").alias("code"), F.concat_ws("/", "sample_id", "lane_id").alias("subject")),
        drift.groupBy("sample_id").agg(F.min("meta").alias("a"), F.max("meta").alias("b")).where("a <> b").select(
            F.lit("METADATA_DIFFERS").alias("code"), F.col("sample_id").alias("subject")),
        rows.agg(F.min(layout).alias("a"), F.max(layout).alias("b")).where("a <> b").select(
            F.lit("MIXED_LAYOUT").alias("code"), F.lit("").alias("subject")),
        known.where(F.col("role").isin("fastq_r1", "fastq_r2")).join(reads.select("role", "name"), ["role", "name"], "left_anti").select(
            F.lit("UNUSED_READ_FILE").alias("code"), F.col("name").alias("subject")),
    ]
    if max_rows is not None:
        parts.append(rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows).select(F.lit("SHEET_TOO_LONG").alias("code"), F.lit("").alias("subject")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lane_manifest(sheet: DataFrame) -> DataFrame:
    """One row per sample: its lanes in order and the library layout."""
    lane = F.struct(
        F.when(F.coalesce(F.trim("lane_id"), F.lit("")) == "", "lane_1").otherwise(F.trim("lane_id")).alias("lane_id"),
        F.col("read1"),
        F.expr("nullif(read2, '')").alias("read2"),
    )
    return sheet.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(lane)).alias("lanes"),  # a sheet has at most MAX_LANE_ROWS lanes
        F.count(F.lit(1)).alias("lane_count"),
        F.max(F.when(F.coalesce("read2", F.lit("")) == "", "single_end").otherwise("paired_end")).alias("layout"),
    )


def array_findings(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """Sheet rows and files must match one to one: (code, subject)."""
    names = files.select(F.col("name").alias("cel_file")).distinct()
    parts = [
        sheet.groupBy("sample_id").count().where("count > 1").select(F.lit("DUPLICATE_SAMPLE").alias("code"), F.col("sample_id").alias("subject")),
        sheet.where(F.col("cel_file").rlike("[/\\\\]")).select(F.lit("NOT_A_BASENAME").alias("code"), F.col("cel_file").alias("subject")),
        sheet.join(names, "cel_file", "left_anti").select(F.lit("FILE_MISSING").alias("code"), F.col("cel_file").alias("subject")),
        sheet.groupBy("cel_file").count().where("count > 1").select(F.lit("FILE_REUSED").alias("code"), F.col("cel_file").alias("subject")),
        names.join(sheet, "cel_file", "left_anti").select(F.lit("FILE_UNUSED").alias("code"), F.col("cel_file").alias("subject")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_cohort_xml(spark: SparkSession, path: str, response_tag: str, recode: dict[str, str]) -> DataFrame:
    """Sample elements of a public cohort document: accession, title, characteristics as a map,
    recoded response, and the id of the patient."""
    characteristic = "STRUCT<_VALUE: STRING, _tag: STRING>"
    supplement = "STRUCT<_VALUE: STRING, _type: STRING>"
    schema = (
        f"Accession STRUCT<_VALUE: STRING>, Title STRING, "
        f"Channel ARRAY<STRUCT<Characteristics: ARRAY<{characteristic}>>>, "
        f"`Supplementary-Data` ARRAY<{supplement}>"
    )
    raw = spark.read.format("xml").option("rowTag", "Sample").schema(schema).load(path)
    items = F.flatten(F.transform("Channel", lambda c: c["Characteristics"]))
    pairs = F.transform(items, lambda c: F.struct(F.lower(F.trim(c["_tag"])).alias("key"), F.trim(c["_VALUE"]).alias("value")))
    rows = raw.select(
        F.trim("Accession._VALUE").alias("accession"),
        F.trim("Title").alias("title"),
        F.map_from_entries(F.array_distinct(pairs)).alias("characteristics"),
        F.filter("Supplementary-Data", lambda s: F.upper(s["_type"]) == "CEL").alias("cel"),
    )
    raw_response = F.element_at("characteristics", response_tag)
    response = F.element_at(F.create_map(*[F.lit(x) for kv in recode.items() for x in kv]), raw_response)
    title = F.col("title")
    patient = (
        F.when(title.startswith("BC_Patient"), F.split(F.regexp_replace(title, "^BC_", ""), "_Genearray")[0])
        .when(title.contains("OU-"), F.element_at(F.split(title, " "), -1))
        .otherwise(F.col("accession"))
    )
    return rows.select(
        "accession", "title", "characteristics",
        F.element_at(F.split(F.get("cel", F.lit(0))["_VALUE"], "/"), -1).alias("cel_file"),
        F.size("cel").alias("cel_count"), response.alias("response"), patient.alias("patient_id"),
    )

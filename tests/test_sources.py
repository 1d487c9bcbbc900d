import gzip
import os

import pytest

from exprspark.sources import bundle, intake, tables
from exprspark.operators import studies, validate
from exprspark.plans import intake_queries
from exprspark.plans.catalogue import QUERIES


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_table_scan_handles_mark_delimiter_and_gzip(spark, tmp_path):
    plain = write(tmp_path / "a.csv", "﻿gene,s1\nG1,3\n")
    assert tables.detect_delimiter(spark, plain) == ","
    assert tables.read_table(spark, plain).columns == ["gene", "s1"]
    packed = str(tmp_path / "b.tsv.gz")
    with gzip.open(packed, "wt", encoding="utf-8") as f:
        f.write("gene\ts1\nG1\t3\n")
    assert tables.read_table(spark, packed).collect() == [("G1", "3")]
    lines = tables.read_lines(spark, plain).orderBy("line_number").collect()
    assert [tuple(r) for r in lines] == [(1, "gene,s1"), (2, "G1,3")]


def test_set_files_and_their_errors(spark, tmp_path):
    good = tables.read_gmt(spark, write(tmp_path / "a.gmt", "one\td\tA\tB\tA\n\ntwo\td\tC\n"))
    assert {(r["set_id"], r["identifier"]): r["requested"] for r in good.collect()} == {("one", "A"): 2, ("one", "B"): 1, ("two", "C"): 1}
    with pytest.raises(tables.SourceError):
        tables.read_gmt(spark, write(tmp_path / "b.gmt", "one\td\tA\none\td\tB\n"))
    with pytest.raises(tables.SourceError):
        tables.read_gene_list(spark, write(tmp_path / "c.tsv", "gene_id\tweight\nA\t1\nA\t2\n"))
    with pytest.raises(tables.SourceError, match="condition"):
        tables.read_assignments(spark, write(tmp_path / "d.tsv", "measurement_id\nm\n"), ["measurement_id", "condition"])
    with pytest.raises(tables.SourceError):
        tables.read_truth(spark, write(tmp_path / "e.tsv", "sample_id\tresponse\na\tyes\na\tno\n"), ["no", "yes"])


def test_conflicting_annotation_is_refused(spark, tmp_path):
    line = 'chr1\tx\texon\t1\t2\t.\t+\t.\tgene_id "G%d"; transcript_id "T1";\n'
    with pytest.raises(tables.SourceError):
        intake.read_gtf(spark, write(tmp_path / "a.gtf", "#c\n" + line % 1 + line % 2))


def test_bundles_are_immutable_and_checked(spark, tmp_path):
    cells = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", 2.0), ("b", "s1", 3.0), ("b", "s2", 0.0)], "feature_id string, sample_id string, value double")
    meta = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    root = str(tmp_path / "bundle")
    bundle.write_bundle(root, 1, {"raw_counts": cells}, sample_metadata=meta)
    assert bundle.load_assay(spark, root, 1, "raw_counts").count() == 4
    with pytest.raises(Exception, match="exist"):
        bundle.write_bundle(root, 1, {"raw_counts": cells}, sample_metadata=meta)
    bundle.add_assay(root, 1, "tpm", cells.where("value > 0"))
    with pytest.raises(tables.SourceError, match="absent_cells"):
        bundle.load_assay(spark, root, 1, "tpm")
    with pytest.raises(tables.SourceError):
        bundle.load_assay(spark, root, 1, "probe_expression")
    assert os.path.isdir(os.path.join(root, "version=1", "assays", "assay=tpm"))


def test_missing_tokens_do_not_make_a_column_text(spark):
    meta = spark.createDataFrame([("a", "1", "x"), ("b", "NA", "y"), ("c", "2.5", "x")], "sample_id string, age string, arm string")
    found = {r["variable"]: tuple(r)[1:] for r in validate.profile_variables(meta).collect()}
    assert found == {"age": ("numeric", 1, 2), "arm": ("categorical", 0, 2)}


def test_criteria_cover_every_outcome(spark):
    metrics = spark.createDataFrame([("icc", 0.8), ("repeatability_sd", None), ("categorical_agreement", 0.5)], "metric string, observed double")
    criteria = spark.createDataFrame(
        [("a", "icc", "classifier_score", "gte", [0.7]), ("b", "icc", "classifier_score", "between", [0.0, 0.5]), ("c", "repeatability_sd", "classifier_score", "lte", [1.0]),
         ("d", "icc", "predicted_class", "gte", [0.1]), ("e", "categorical_agreement", "predicted_class", "near", [0.5])],
        "criterion_id string, metric string, endpoint string, operator string, threshold array<double>")
    got = {r["criterion_id"]: r["status"] for r in studies.evaluate_criteria(metrics, criteria, "precision").collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "INDETERMINATE", "d": "NOT_APPLICABLE", "e": "NOT_APPLICABLE"}


def test_only_an_uploaded_sheet_has_a_largest_length(spark):
    sheet = spark.range(3).selectExpr("concat('s', id) as sample_id", "concat('lane_', id) as lane_id", "concat('f', id) as read1", "'' as read2", "'x' as batch")
    files = sheet.selectExpr("'fastq_r1' as role", "read1 as name")
    assert [r["code"] for r in intake.lane_findings(sheet, files, ["batch"], max_rows=2).collect()] == ["SHEET_TOO_LONG"]
    assert intake.lane_findings(sheet, files, ["batch"]).isEmpty()


def test_lane_query_judges_a_table_of_any_length(spark, tmp_path):
    spark.range(10_001).selectExpr("id as s_suppkey", "concat('Supplier#', id) as s_name", "cast(id % 25 as int) as s_nationkey", "100D as s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    assert QUERIES["src_lane_findings"](spark, str(tmp_path)).isEmpty()


@pytest.mark.parametrize("name", ["snk_audit_files", "src_cohort_xml"])
def test_no_task_gets_all_rows_in_one_file(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(intake_queries, "FILE_ROWS", 20, raising=False)
    monkeypatch.setattr(intake_queries, "scratch_path", lambda _, part: f"{tmp_path}/{part}")
    got = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    files = [p for p in tmp_path.rglob("part-*") if p.is_file()]
    if name == "snk_audit_files":
        assert sum(r["count"] for r in got) == len({p.parent for p in files})
    else:
        assert len(got) == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
        assert max(p.read_text().count("<Sample>") for p in files) <= 20
    assert len(files) > 5


def test_sample_folders_are_read_from_their_root(spark, tmp_path):
    """One listing of the whole tree: the same rows as by a pattern, columns by header, a header of its own is an error."""
    quant, stats = tmp_path / "quant", tmp_path / "stats"
    for i in range(40):
        (quant / f"s {i}").mkdir(parents=True)
        (quant / f"s {i}" / "quant.sf").write_text(f"TPM\tName\tEffectiveLength\tNumReads\n{i}.5\tt{i}\t100\t{i}\n")
        (stats / f"s {i}" / "aux_info").mkdir(parents=True)
        (stats / f"s {i}" / "aux_info" / "meta_info.json").write_text(f'{{\n"num_processed": {i + 2},\n"num_mapped": {i}}}\n')
    rows = sorted(tuple(r) for r in intake.read_quantifications(spark, str(quant), ".sf").collect())
    assert rows == sorted((f"s {i}", f"t{i}", 100.0, i + 0.5, float(i)) for i in range(40))
    assert rows == sorted(tuple(r) for r in intake.read_quantifications(spark, f"{quant}/*/quant.sf").collect())
    counts = sorted(tuple(r) for r in intake.read_mapping_statistics(spark, str(stats)).collect())
    assert counts == sorted((f"s {i}", i + 2, i) for i in range(40))
    (quant / "s 7" / "quant.sf").write_text("Name\tTPM\tEffectiveLength\tNumReads\nt7\t7.5\t100\t7\n")
    with pytest.raises(Exception):
        intake.read_quantifications(spark, str(quant), ".sf").collect()


def test_gmt_lines_are_split_once_not_per_member(spark):
    lines = spark.createDataFrame([("a\tfirst\tx\ty\tx",), (" ",), ("b\tsecond\t z ",)], "text string")
    parsed = tables.parse_gmt(lines)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Generate")]
    assert {tuple(r) for r in parsed.collect()} == {("a", "first", "x", 2), ("a", "first", "y", 1), ("b", "second", "z", 1)}

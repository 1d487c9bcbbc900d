"""A cross-section of registered queries against their SQL on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["qc_sample_flags", "qc_log_cpm", "val_cell_checks", "val_variable_profile", "map_collapse_sum", "map_probe_highest_mad", "dim_scaled", "dim_corr_matrix",
         "de_lm_fit", "de_bh", "gse_score", "sig_mean_z", "sig_rank", "dec_composition", "clf_binary_metrics", "clf_assign_folds", "exp_profile_corr", "stu_precision", "stu_levels"]

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="driver tables are absent")


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{BASE}/{table}.parquet'")
    relation = connection.sql(entry_module.oracle_sql()[name])
    frame = entry_module.queries()[name](spark, BASE)
    assert sorted(frame.columns) == sorted(relation.columns)
    order = sorted(frame.columns)

    def ordered(columns, rows):
        places = [columns.index(c) for c in order]
        return sorted((tuple(r[i] for i in places) for r in rows), key=str)

    assert ordered(frame.columns, [tuple(r) for r in frame.collect()]) == ordered(relation.columns, relation.fetchall())


def test_entry_works_without_the_document_folder(monkeypatch):
    for absent in ("corpus_pipeline", "exprspark.llm"):
        with monkeypatch.context() as patch:
            patch.setitem(__import__("sys").modules, absent, None)
            assert not [n for n in entry_module.queries() if n == "pipeline" or n.startswith("op")]
            assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

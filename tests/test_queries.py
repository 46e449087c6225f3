"""Registered queries against their SQL. TIDEWATCH_ALL=1 compares every query, else one of each kind."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tools")

import __spark_entry__ as E  # noqa: E402
from check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = ["io1_csv_scan", "io4_union_tagged", "p3_quality_gate", "p24_attenuation_correction", "j7_cone_search", "j14_interval_anti_join", "j19_knn_join", "a12_ratio_of_sums", "a24_grouping_sets", "w4_first_acceptable",
        "w8_sample_k", "s2_exclusion_union", "t2_interval_union", "t4_good_intervals", "t11_burst_shapes", "e8_interval_summary", "e17_pooled_permutation", "m12_quadratic_discriminant", "r2_stream_sessions"]


def test_every_sql_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(SOME) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()) if os.environ.get("TIDEWATCH_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    message, _, ok = compare(spark, con, name, SF)
    assert ok, message


def test_entry(spark):
    assert E.entry(spark).count() > 0

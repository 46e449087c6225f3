"""Counts of overlaps are those of the pairs, and no pair becomes a row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.columns import sep_deg
from tidewatch.operators import intervals as I


def table(n, seed, backward=False):
    rng = np.random.default_rng(seed)
    start = rng.uniform(-50, 1000, n).round(1)
    length = rng.choice([0.0, 1.0, 7.3, 40.0, 900.0], n) * (rng.choice([1, -1], n) if backward else 1)
    who = rng.integers(0, 25, n)
    return pd.DataFrame({"grp": rng.integers(0, 2, n), "event_id": rng.integers(0, int(0.9 * n), n), "who": who, "start": start, "stop": start + length, "ra": who * 37.0 % 360, "dec": who * 7.0 - 85.0})


def by_pairs(a, b, tol):
    j = I.overlap_join(a, b.drop("event_id"), ["grp"])
    same = F.col("who") == F.col("b_who")
    view = same | (sep_deg("ra", "dec", "b_ra", "b_dec") <= tol)
    return j.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_any"), F.count(F.when(same, 1)).alias("n_same"), F.count(F.when(view, 1)).alias("n_in_view"))


@pytest.mark.parametrize("tol,part,backward", [(25.0, 16384, False), (25.0, 13, True), (0.0, 50, False), (180.0, 16384, False)])
def test_counts_equal_those_of_pairs(spark, monkeypatch, tol, part, backward):
    monkeypatch.setattr(I, "PART_ROWS", part)
    a, b = spark.createDataFrame(table(300, 1, backward)), spark.createDataFrame(table(400, 2, backward))
    got = {tuple(r) for r in I.overlap_counts(a, b, ["grp"], "event_id", "who", tol).collect()}
    assert got == {tuple(r) for r in by_pairs(a, b, tol).collect()} and len(got) > 100


def test_pairs_are_not_rows(spark):
    one = {"grp": 1, "who": range(3000), "start": 0.0, "stop": 1.0, "ra": 10.0, "dec": np.linspace(-90, 90, 3000)}
    a, b = spark.createDataFrame(pd.DataFrame({"event_id": range(3000)} | one)), spark.createDataFrame(pd.DataFrame(one))
    n = I.overlap_counts(a, b, ["grp"], "event_id", "who", 25.0)
    assert "SortMergeJoin [who" not in n._jdf.queryExecution().executedPlan().toString()
    got = n.agg(F.sum("n_any"), F.sum("n_same"), F.count(F.lit(1))).first()
    assert tuple(got) == (9_000_000, 3000, 3000)


def test_rows_with_nulls_meet_nothing(spark):
    a = spark.createDataFrame([(1, 1, 5, 0.0, 1.0, 3.0, 4.0), (2, 1, 5, None, 1.0, 3.0, 4.0), (3, None, 5, 0.0, 1.0, 3.0, 4.0)], "event_id int, grp int, who int, start double, stop double, ra double, dec double")
    assert [tuple(r) for r in I.overlap_counts(a, a.drop("event_id"), ["grp"], "event_id", "who", 1.0).collect()] == [(1, 1, 1, 1)]
    assert I.overlap_counts(a, a.where("false"), ["grp"], "event_id", "who", 1.0).count() == 0

"""Leave-one-out mean differences and flags of missing columns."""

import pytest

from tidewatch.operators import evaluate as V
from tidewatch.operators import models as M


def test_mean_influence(spark):
    rows = [("k", 1, True, 3.0), ("k", 2, True, 5.0), ("k", 3, False, 1.0), ("k", 4, False, None), ("k", 5, True, None), ("one", 1, True, 2.0)]
    got = {(r.k, r.left_out): (r.difference, r.difference_all) for r in V.mean_influence(spark.createDataFrame(rows, "k string, source_id long, positive boolean, v double"), ["k"], "v").collect()}
    assert got == {("k", 1): (4.0, 3.0), ("k", 2): (2.0, 3.0), ("k", 3): (None, 3.0), ("one", 1): (None, None)}
    whole = V.mean_influence(spark.createDataFrame(rows[:3], "k string, source_id long, positive boolean, v double"), [], "v")
    assert {r.left_out: r.difference for r in whole.collect()} == {1: pytest.approx(4.0), 2: pytest.approx(2.0), 3: None}


def test_flags_of_missing_columns(spark):
    df = spark.createDataFrame([(1, 0, None, 2.0), (2, 1, 4.0, None), (3, 1, 6.0, 1.0)], "id long, fold int, a double, b double")
    got = {r.id: (r.a, r.b, r.a_missing, r.b_missing, r.any_missing) for r in M.median_fill(df, "fold", ["a", "b"], 2, each=True).collect()}
    assert got == {1: (5.0, 2.0, 1, 0, 1), 2: (4.0, 2.0, 0, 1, 1), 3: (6.0, 1.0, 0, 0, 0)}

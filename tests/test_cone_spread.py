"""Cone joins of small tables use all tasks, and matches around known centres give the extents of all matches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins as J


def places(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": range(n), "ra": rng.random(n) * 360, "dec": np.degrees(np.arcsin(rng.uniform(-1, 1, n))), "positive": rng.random(n) < 0.1})


def test_pairs_of_small_tables_are_made_by_many_tasks(spark):
    a, b = spark.createDataFrame(places(300, 1)).coalesce(1), spark.createDataFrame(places(3000, 2)).coalesce(1)
    assert J.cone_join(a, b, 4.0).select(F.spark_partition_id().alias("p")).distinct().count() > 4


@pytest.mark.parametrize("limit", ["2000000", "30"])
def test_extent_around_a_centre_equals_the_hull(spark, limit):
    spark.conf.set("spark.tidewatch.maxGroupRows", limit)
    try:
        m = J.cone_join(spark.createDataFrame(places(40, 3)), spark.createDataFrame(places(4000, 4)), 6.0).withColumnRenamed("l_id", "key")
        plain = {r.key: r for r in J.ambiguous(m, "key", "r_positive", "r_ra", "r_dec", 6.0, "r_id").collect()}
        quick = {r.key: r for r in J.ambiguous(m, "key", "r_positive", "r_ra", "r_dec", 6.0, "r_id", centre=("l_ra", "l_dec", "sep")).collect()}
    finally:
        spark.conf.unset("spark.tidewatch.maxGroupRows")
    assert plain.keys() == quick.keys() and len(plain) > 30
    for k, p in plain.items():
        assert (quick[k].n, quick[k].n_cls, quick[k].rejected) == (p.n, p.n_cls, p.rejected) and quick[k].extent == pytest.approx(p.extent, abs=1e-9)

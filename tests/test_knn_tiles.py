"""Neighbours by tiles against all distances: copies, rare groups, outliers, two tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import knn as K


def brute(a, b, features, k):
    out = {}
    for i, row in a.iterrows():
        o = b[b.g != row.g]
        d = np.sqrt(sum((o[f].to_numpy() - row[f]) ** 2 for f in features))
        at = np.lexsort((o.id, d))[:k]
        out[row.id] = list(zip(range(1, k + 1), o.id.to_numpy()[at].tolist(), d[at].tolist()))
    return out


def same(spark, a, b, features, k):
    got = K.knn_join(spark.createDataFrame(a), spark.createDataFrame(b), features, k, "g").orderBy("id", "rank").toPandas()
    want = brute(a, b, features, k)
    for i, rows in want.items():
        part = got[got.id == i]
        assert list(zip(part["rank"], part.r_id, part.dist)) == rows
    assert len(got) == sum(map(len, want.values()))


@pytest.fixture
def small(monkeypatch):
    for name, n in (("TILE_ROWS", 12), ("PART_ROWS", 10), ("ARRAY_CELLS", 64)):
        monkeypatch.setattr(K, name, n)


def test_copies_and_outliers(spark, small):
    rng = np.random.default_rng(1)
    a = np.r_[np.repeat(rng.normal(size=(6, 2)), 25, 0), rng.normal(size=(60, 2)), [[1e6, -1e7]], 1e-9 * rng.normal(size=(40, 2))]
    d = pd.DataFrame(a, columns=["x", "y"]).assign(id=rng.permutation(len(a)), g=rng.integers(0, 4, len(a)))
    same(spark, d, d, ["x", "y"], 5)


def test_groups_apart_and_rare_groups(spark, small):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 1)) + np.repeat([0.0, 50.0, 51.0], 50)[:, None]
    d = pd.DataFrame(x, columns=["x"]).assign(id=range(150), g=["one"] * 50 + ["two"] * 97 + ["three"] * 3)
    same(spark, d, d, ["x"], 7)
    same(spark, d[d.g != "two"], d[d.g != "two"], ["x"], 60)


def test_two_tables_of_three_features(spark, small):
    rng = np.random.default_rng(3)
    a, b = (pd.DataFrame(rng.normal(size=(n, 3)), columns=list("xyz")).assign(id=range(n), g=rng.integers(0, 3, n)) for n in (40, 90))
    same(spark, a, b, list("xyz"), 4)
    one = spark.createDataFrame(a).withColumn("keep", F.lit("k"))
    odd = one.withColumn("x", F.when(F.col("id") == 0, float("nan")).when(F.col("id") == 1, None).otherwise(F.col("x")))
    got = K.knn_join(odd, odd, list("xyz"), 2, "g", keep=["keep"]).toPandas()
    assert set(got.id) == set(range(2, 40)) and set(got.r_id).isdisjoint({0, 1}) and set(got.r_keep) == {"k"}
    assert K.knn_join(one, one.where("false"), list("xyz"), 2, "g", keep=["keep"]).columns == ["id", "rank", "dist", "r_id", "r_keep"]


def test_few_rows_are_shuffled(spark):
    """Every left row brings about k rows to the last step, not all rows of the cells around it."""
    rng = np.random.default_rng(4)
    d = spark.createDataFrame(pd.DataFrame(rng.normal(size=(6000, 2)), columns=["x", "y"]).assign(id=range(6000), g=lambda f: f["id"] % 20))
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        it, n = store.stageList(None, False, False, none, None).iterator(), {}
        while it.hasNext():
            s = it.next()
            n[s.stageId()] = s.shuffleWriteRecords()
        return n

    before = written()
    assert K.knn_join(d, d, ["x", "y"], 25, "g").count() == 150_000
    assert sum(n for i, n in written().items() if i not in before) < 300_000

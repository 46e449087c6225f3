"""Iterative fits and neighbours against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import knn as K
from tidewatch.operators import models as M


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 240
    y = rng.random(n) < 0.35
    x = rng.normal(size=(n, 2)) + 0.8 * y[:, None]
    return pd.DataFrame({"id": range(n), "source_id": rng.integers(0, 12, n), "positive": y, "f1": x[:, 0], "f2": x[:, 1]}).assign(fold=lambda d: d.source_id % 4)


def newton(x, y, w, c):
    z = np.c_[np.ones(len(x)), x]
    b, pen = np.zeros(z.shape[1]), np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        g = c * z.T @ (w * (y - p)) - pen * b
        h = c * (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen)
        b = b + np.linalg.solve(h, g)
    return b


@pytest.mark.parametrize("c", [0.1, 1.0])
def test_logit_batch_equals_single_fits(spark, data, c):
    got = M.held_out_logit(spark.createDataFrame(data), "fold", 4, ["f1", "f2"], c).toPandas().set_index("id").score
    for k in range(4):
        tr, te = data[data.fold != k], data[data.fold == k]
        x = tr[["f1", "f2"]].to_numpy()
        m, s = x.mean(0), x.std(0)
        y = tr.positive.to_numpy().astype(float)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        b = newton((x - m) / s, y, w, c)
        want = 1 / (1 + np.exp(-(b[0] + ((te[["f1", "f2"]].to_numpy() - m) / s) @ b[1:])))
        assert np.allclose(got[te.id].to_numpy(), want, atol=1e-7)


def test_neighbours_with_clumps_and_outliers(spark):
    rng = np.random.default_rng(6)
    a = np.r_[rng.normal(size=(80, 2)), 1e-4 * rng.normal(size=(80, 2)) + 3, [[40.0, -35.0]], np.zeros((30, 2))]
    d = pd.DataFrame(a, columns=["x", "y"]).assign(id=range(len(a)), g=lambda f: f["id"] % 5)
    got = K.knn_join(spark.createDataFrame(d), spark.createDataFrame(d), ["x", "y"], 6, "g").toPandas()
    assert len(got) == 6 * len(d)
    for i, part in got.groupby("id"):
        o = d[d.g != d.g[i]]
        dist = np.hypot(o.x - d.x[i], o.y - d.y[i])
        want = o.id.to_numpy()[np.lexsort((o.id, dist))][:6]
        assert list(part.sort_values("rank").r_id) == list(want)


def test_class_weights_move_no_rows(spark):
    d = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 10 > 7).alias("positive")).repartition(7)
    w = M.balanced_weights(d)
    assert {(r.positive, r.weight) for r in w.collect()} == {(None, 5.0), (True, 2.5), (False, 100 / 140)}
    assert w.select(F.spark_partition_id()).distinct().count() == 7 and "hashpartitioning(positive" not in w._jdf.queryExecution().executedPlan().toString()


def test_nested_selection_picks_from_grid(spark, data):
    chosen, oof = M.nested_selection(spark.createDataFrame(data), "fold", 4, ["f1", "f2"], [0.01, 1.0], "source_id")
    c = chosen.toPandas()
    assert len(c) == 4 and set(c.config) <= {0, 1} and oof.count() == len(data)


def test_estimators_separate_classes(spark, data):
    df = spark.createDataFrame(data.assign(fold=data.source_id % 2))
    for fit in (M.forest(10, depth=6), M.boosted(4), M.kernel_margin(["f1", "f2"], 16, max_iter=15)):
        s = M.held_out_ml(df, "fold", 2, ["f1", "f2"], fit).toPandas()
        assert len(s) == len(data)
        assert s[s.positive].score.mean() > s[~s.positive].score.mean()

"""Fits of many folds by Gramian arrays against a plain Newton fit of each fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_models import newton
from tidewatch.operators import gramian as G
from tidewatch.operators.models import Task

D = 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 600
    y = rng.random(n) < 0.3
    x = rng.normal(size=(n, D)) * np.linspace(0.1, 30, D) + 0.5 * y[:, None] + 1000.0
    x[:, 5] = 7.0
    return pd.DataFrame({"id": range(n), "fold": rng.integers(0, 15, n), "positive": y, "weight": rng.uniform(0.2, 3, n)}).assign(x=list(x))


def frame(spark, data):
    return spark.createDataFrame([(int(r.id), int(r.fold), bool(r.positive), float(r.weight), [float(v) for v in r.x]) for r in data.itertuples()], "id long, fold int, positive boolean, weight double, x array<double>")


def plain(train, test, c, weighted, use=None):
    a, b = np.stack(train.x)[:, use or range(D)], np.stack(test.x)[:, use or range(D)]
    m, s = a.mean(0), a.std(0)
    keep = s > 0
    y, w = train.positive.to_numpy().astype(float), train.weight.to_numpy() if weighted else np.ones(len(train))
    w = w * np.where(y == 1, len(y) / (2 * w[y == 1].sum()), len(y) / (2 * w[y == 0].sum()))
    beta = newton(((a - m)[:, keep]) / s[keep], y, w, c)
    return 1 / (1 + np.exp(-(beta[0] + ((b - m)[:, keep] / s[keep]) @ beta[1:])))


@pytest.mark.parametrize("c,weighted", [(1.0, False), (0.05, True), (50.0, False)])
def test_held_out_equals_single_fits(spark, data, c, weighted):
    scores, params = G.held_out(frame(spark, data), "fold", "x", c, "weight" if weighted else None)
    got = scores.toPandas().set_index("id").score
    for k in range(15):
        test = data[data.fold == k]
        assert np.allclose(got[test.id].to_numpy(), plain(data[data.fold != k], test, c, weighted), atol=1e-7)
    flat = G.stationarity(frame(spark, data), params, "fold", "x", c, "weight" if weighted else None).toPandas()
    assert len(flat) == 15 and flat.gradient.max() < 1e-6
    moved = params.withColumn("intercept", F.col("intercept") + 0.01)
    assert G.stationarity(frame(spark, data), moved, "fold", "x", c, "weight" if weighted else None).toPandas().gradient.min() > 1e-3


def test_extra_rows_and_small_feature_sets(spark, data):
    old, new = data[data.fold < 10], data[data.fold >= 10]
    scores, _ = G.held_out(frame(spark, old), "fold", "x", extra=frame(spark, new).drop("fold"))
    got = scores.toPandas().set_index("id").score
    for k in (0, 7):
        test = old[old.fold == k]
        assert np.allclose(got[test.id].to_numpy(), plain(data[data.fold != k], test, 1.0, False), atol=1e-7)
    fits = G.fit_vectors(frame(spark, data), "fold", "x", [Task(f"{i}.{k}", (k, 3), 1.0, (i, 2)) for i in (0, 4, 5) for k in (1, 2)])
    for i in (0, 4):
        test = data[data.fold == 1]
        f = fits[f"{i}.1"]
        score = 1 / (1 + np.exp(-(np.stack(test.x) @ f["slopes"] + f["intercept"])))
        assert np.allclose(score, plain(data[~data.fold.isin([1, 3])], test, 1.0, False, [i, 2]), atol=1e-7)
    assert fits["5.1"]["slopes"][5] == 0 and set(np.flatnonzero(fits["4.1"]["slopes"])) == {2, 4}


def test_unusable_rows_are_not_learnt_from(spark, data):
    df = frame(spark, data.head(200))
    odd = spark.createDataFrame([(9000, 1, True, 1.0, None), (9001, 1, True, 1.0, [None] * D), (9002, 2, False, 1.0, [float("nan")] * D), (9003, 2, False, 1.0, [1.0])], df.schema)
    a, b = G.fit_vectors(df, "fold", "x", [Task("all", ())])["all"], G.fit_vectors(df.union(odd), "fold", "x", [Task("all", ())])["all"]
    assert np.allclose(a["slopes"], b["slopes"], atol=1e-9)
    assert G.fit_vectors(df.where("false"), "fold", "x", [Task("all", ())]) == {}


def test_arrays_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(G, "FAN_IN", 3)
    parts = spark.range(40).repartition(10).select((F.col("id") % 3).cast("int").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("sums"))
    assert {k: v.tolist() for k, v in G.array_sums(parts).items()} == {k: [float(sum(range(k, 40, 3))), float(len(range(k, 40, 3)))] for k in range(3)}


def test_gradient_of_a_table_with_unusable_rows(spark, data):
    odd = spark.createDataFrame([(9000 + i, i % 3, True, 1.0, [None, [float("nan")] * D, [1.0]][i % 3]) for i in range(30)], frame(spark, data.head(1)).schema)
    df = frame(spark, data).union(odd)
    flat = G.stationarity(df, G.held_out(df, "fold", "x")[1], "fold", "x").toPandas().set_index("model")
    assert len(flat) == 15 and flat.gradient.max() < 1e-6
    assert flat.n_train["1"] == (data.fold != 1).sum() + 20


def test_gradients_of_few_models_at_once(spark, data, monkeypatch):
    df = frame(spark, data)
    params = G.held_out(df, "fold", "x")[1].withColumn("intercept", F.col("intercept") + 0.01)
    want = G.stationarity(df, params, "fold", "x").toPandas().set_index("model").gradient
    monkeypatch.setattr(G, "NUMBERS_AT_ONCE", 60)
    got = G.stationarity(df, params, "fold", "x").toPandas().set_index("model").gradient
    assert np.allclose(got[want.index], want, rtol=1e-9)

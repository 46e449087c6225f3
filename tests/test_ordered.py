"""Ordered computations: the cell path equals pandas, with a hot key and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import intervals as I
from tidewatch.operators import ordered as O
from tidewatch.operators.evaluate import auc


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 900
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefg"), n))
    t = np.where(rng.random(n) < 0.35, 50.0, np.round(rng.random(n) * 100, 1))
    return pd.DataFrame({"key": key, "t": t, "id": np.arange(n), "name": [f"n{i * 7919 % n:05d}" for i in range(n)], "x": np.round(rng.normal(size=n), 2)})


def test_running_and_totals(spark, frame, small_groups):
    df = spark.createDataFrame(frame)
    got = O.scan(df, ["key"], "t", ["id"], running={"n": ("sum", F.lit(1).cast("long"), True), "sx": ("sum", F.col("x"), False), "top": ("max", F.col("x"), False), "prev": ("last", F.col("t"), False)},
                 totals={"all": ("sum", F.col("x"))}, n_cells=9).toPandas().sort_values("id").reset_index(drop=True)
    p = frame.sort_values(["key", "t", "id"])
    g = p.groupby("key")
    p = p.assign(n=g.cumcount() + 1, sx=g.x.cumsum() - p.x, top=g.x.cummax().groupby(p.key).shift(1), prev=g.t.shift(1), all=g.x.transform("sum")).sort_values("id").reset_index(drop=True)
    assert len(got) == len(frame)
    assert (got.n == p.n).all()
    for c in ("sx", "all"):
        assert np.allclose(got[c], p[c])
    for c in ("top", "prev"):
        assert np.allclose(got[c].fillna(-9), p[c].fillna(-9))


def test_descending_and_text_tie(spark, frame, small_groups):
    df = spark.createDataFrame(frame)
    got = O.row_index(df, ["key"], "t", ["name"], n_cells=9).toPandas().set_index("id").rn
    p = frame.sort_values(["key", "t", "name"])
    want = (p.groupby("key").cumcount() + 1).set_axis(p["id"])
    assert (got.sort_index() == want.sort_index()).all()
    nxt = I.following(df.dropDuplicates(["key", "t"]), ["key"], "t", F.col("t"), "nxt", 7).toPandas()
    q = frame.drop_duplicates(["key", "t"]).sort_values(["key", "t"])
    q = q.assign(want=q.groupby("key").t.shift(-1)).set_index(["key", "t"]).want
    m = nxt.set_index(["key", "t"]).nxt.reindex(q.index)
    assert np.allclose(m.fillna(-1), q.fillna(-1))


def test_null_keys_are_kept(spark, small_groups):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0), (None, 3.0), (None, 4.0)], "key string, t double")
    got = O.row_index(df, ["key"], "t", n_cells=2).where("key is null").toPandas()
    assert sorted(got.rn) == [1, 2, 3, 4]


@pytest.mark.parametrize("k", [1, 3, 8, 400])
def test_equal_count_bins_match_array_split(spark, frame, k):
    df = spark.createDataFrame(frame)
    for n in (0, 7):
        got = O.equal_count_bins(df, ["key"], "t", ["id"], k=k, n_cells=n).toPandas()
        for _, g in got.sort_values(["t", "id"]).groupby("key"):
            want = np.concatenate([np.full(len(part), i + 1) for i, part in enumerate(np.array_split(np.arange(len(g)), k))])
            assert (g.bin.to_numpy() == want).all()


def test_percentiles_and_rank_correlation(spark, frame, small_groups):
    df = spark.createDataFrame(frame)
    p = O.percentiles(df, ["key"], "x", {"a": 0.1, "m": 0.5, "z": 0.975}).toPandas().set_index("key")
    for k, g in frame.groupby("key"):
        assert np.allclose(p.loc[k, ["a", "m", "z"]].to_numpy(dtype=float), np.percentile(g.x, [10, 50, 97.5]))
    r = O.spearman(df, ["key"], "t", "x").toPandas().set_index("key").rho
    for k, g in frame.groupby("key"):
        assert np.isclose(r[k], np.corrcoef(g.t.rank(), g.x.rank())[0, 1])


def test_weighted_auc_against_all_pairs(spark, frame, small_groups):
    f = frame.assign(positive=frame["id"] % 3 == 0, w=1.0 + frame["id"] % 4)
    got = auc(spark.createDataFrame(f), ["key"], "x", F.col("w")).toPandas().set_index("key").auc
    for k, g in f.groupby("key"):
        a, b = g[g.positive], g[~g.positive]
        win = (a.x.to_numpy()[:, None] > b.x.to_numpy()) + 0.5 * (a.x.to_numpy()[:, None] == b.x.to_numpy())
        w = a.w.to_numpy()[:, None] * b.w.to_numpy()
        assert np.isclose(got[k], (win * w).sum() / w.sum())


@pytest.mark.parametrize("limit", [None, "3"])
def test_interval_algebra(spark, limit):
    if limit:
        spark.conf.set("spark.tidewatch.maxGroupRows", limit)
    try:
        rng = np.random.default_rng(4)
        a = pd.DataFrame({"k": rng.integers(0, 3, 150), "start": np.round(rng.random(150) * 100, 2)})
        a["stop"] = a.start + np.round(rng.random(150) * 3, 2)
        got = I.merge(spark.createDataFrame(a), ["k"]).toPandas().sort_values(["k", "start"])
        want = []
        for k, g in a.sort_values("start").groupby("k"):
            out = []
            for s, e in g[["start", "stop"]].to_numpy():
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            want += [(k, *x) for x in out]
        assert np.allclose(got.to_numpy(dtype=float), np.array(want, dtype=float))
        pts = pd.DataFrame({"k": rng.integers(0, 3, 200), "t": np.round(rng.random(200) * 100, 2), "id": range(200)})
        inside = set(I.inside(spark.createDataFrame(pts), spark.createDataFrame(a), ["k"], "t").toPandas()["id"])
        assert inside == {r.id for r in pts.itertuples() if ((a.k == r.k) & (a.start <= r.t) & (r.t < a.stop)).any()}
        seg = pts.assign(start=pts.t, stop=pts.t + 0.5)
        for closed in (True, False):
            hit = I.overlapping(spark.createDataFrame(seg), spark.createDataFrame(a), ["k"], closed=closed).toPandas()
            hit = dict(zip(hit["id"], hit["hit"]))
            for r in seg.itertuples():
                m = a[a.k == r.k]
                w = ((m.start <= r.stop) & (m.stop >= r.start)).any() if closed else ((m.start < r.stop) & (m.stop > r.start)).any()
                assert hit[r.id] == w
    finally:
        spark.conf.unset("spark.tidewatch.maxGroupRows")

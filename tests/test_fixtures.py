"""Literal values that the operators must give."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import evaluate as V
from tidewatch.operators import inference as R
from tidewatch.operators import intervals as I
from tidewatch.operators import joins as J
from tidewatch.operators import models as M
from tidewatch.operators import project as P
from tidewatch.operators import select as S
from tidewatch.operators import timing as T
from tidewatch.session import own_folder
from tidewatch.sources.files import read_spaced


def test_threshold_choice(spark):
    rows = [("a", 0.1, False), ("a", 0.2, False), ("a", 0.6, True), ("a", 0.7, True), ("b", 0.1, False), ("b", 0.3, True), ("b", 0.9, True)]
    t = M.best_threshold(spark.createDataFrame(rows, "m string, score double, positive boolean"), ["m"]).toPandas().set_index("m")
    assert t.threshold["a"] == pytest.approx(0.4) and t.balanced_accuracy["a"] == 1.0
    assert t.threshold["b"] == pytest.approx(0.2)


def test_source_equal_weights(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", False), ("d", False)], "g string, positive boolean")
    w = M.source_equal_weights(df, "g").toPandas()
    assert w[w.positive].weight.sum() == pytest.approx(2.5) and w[~w.positive].weight.sum() == pytest.approx(2.5)
    assert set(w[w.g == "a"].weight) == {0.625}


def test_equal_groups_weights_agree(spark):
    df = spark.createDataFrame([(g, g < 2, i) for g in range(5) for i in range(4)], "g int, positive boolean, i int")
    a = M.source_equal_weights(df, "g").toPandas().sort_values(["g", "i"]).weight.to_numpy()
    b = M.balanced_weights(df).toPandas().sort_values(["g", "i"]).weight.to_numpy()
    assert np.allclose(a, b)


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.04, 0.03))], "f string, t int, p double")
    assert np.allclose(S.holm(df, ["f"], "t", "p").toPandas().sort_values("t").p_adjusted, [0.03, 0.06, 0.06])


def test_overlap(spark):
    b = spark.createDataFrame([("k", 0, 1.0, 1.5), ("k", 1, 2.0, 3.0), ("k", 2, 5.0, 6.0)], "k string, i int, start double, stop double")
    g = spark.createDataFrame([("k", 1.4, 2.1)], "k string, start double, stop double")
    assert sorted(r.i for r in I.overlap_join(b, g, ["k"]).collect()) == [0, 1]
    assert sorted(r.i for r in I.overlapping(b, g, ["k"]).where("hit").collect()) == [0, 1]


def test_segments_skip_exclusions(spark):
    g = spark.createDataFrame([("k", 0.0, 100.0), ("k", 200.0, 233.0)], "k string, start double, stop double")
    x = spark.createDataFrame([("k", 40.0, 50.0)], "k string, start double, stop double")
    s = I.clean_segments(g, x, ["k"], 16.0).where("not removed").toPandas()
    assert sorted(s.t0) == [0.0, 16.0, 64.0, 80.0, 200.0, 216.0]


def test_median_fill(spark):
    rows = [(1, 0, 1.0, 2.0), (2, 0, None, None), (3, 0, 3.0, 4.0), (4, 1, None, None)]
    d = M.median_fill(spark.createDataFrame(rows, "id int, fold int, a double, b double"), "fold", ["a", "b"], 2).where("id = 4").first()
    assert (d.a, d.b, d.any_missing) == (2.0, 3.0, 1)


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, True), (0.4, True)], "score double, positive boolean")
    assert V.auc(df, []).first().auc is None


def test_detector_needs_every_block(spark):
    rows = [("o", 0.0, 0, k, 1) for k in range(64)] + [("o", 0.0, 1, k, 1) for k in range(48)]
    on = T.detectors_on(spark.createDataFrame(rows, "obs string, t0 double, det int, k int, n int"), ["obs"], 64, 8).toPandas()
    assert list(on.det) == [0]
    seg = T.pair_segments(T.dft_sums(spark.createDataFrame(rows, "obs string, t0 double, det int, k int, n int"), ["obs"], 64, [1, 2]),
                          T.detectors_on(spark.createDataFrame(rows, "obs string, t0 double, det int, k int, n int"), ["obs"], 64, 8), ["obs"], {"b": (1, 2)}, 64)
    assert seg.count() == 0


def test_centroid_floor(spark):
    d = spark.createDataFrame([(0.0001, 0.0), (0.01, 0.01)], "v0 double, v1 double").select("v0", T.centroid(["v0", "v1"], [1.0, 4.0], 0.05).alias("c")).orderBy("v0").collect()
    assert d[0].c is None and d[1].c == pytest.approx(2.0)


def test_sinusoid_rms_is_recovered(spark):
    n, rms = 256, 0.2
    rng = np.random.default_rng(0)
    rows = []
    for seg in range(6):
        t = np.arange(n)
        rate = 60 * (1 + rms * math.sqrt(2) * np.sin(2 * math.pi * 9 * t / n + seg))
        rows += [("o", float(seg), d, int(k), int(c)) for d in range(3) for k, c in enumerate(rng.poisson(rate)) if c]
    cube = spark.createDataFrame(pd.DataFrame(rows, columns=["obs", "t0", "det", "k", "n"]))
    on = T.detectors_on(cube, ["obs"], n, 8)
    bands = {"t": (4, 20)}
    want = rms * abs(np.sinc(9 / n))
    for seg in (T.pair_segments(T.dft_sums(cube, ["obs"], n, range(1, 128)), on, ["obs"], bands, n), T.two_group_segments(T.dft_fft(cube, ["obs"], n, range(1, 128)), on, ["obs"], bands, n)):
        got = T.mean_variance(seg, ["obs"], ["t"]).first()
        assert got.t == pytest.approx(want, rel=0.1) or got.t == pytest.approx(rms, rel=0.1)


def test_lorentzian_width(spark):
    edges = [(2.0 ** i - 0.5, 2.0 ** (i + 1) - 0.5) for i in range(10)]
    for width in (2.0, 32.0):
        y = [0.04 * 2 / math.pi * (math.atan(hi / width) - math.atan(lo / width)) for lo, hi in edges]
        names = [f"y{i}" for i in range(10)]
        df = spark.createDataFrame([("o", *y, *[2e-3] * 10)], "obs string, " + ", ".join(f"{n} double" for n in names) + ", " + ", ".join(f"e{i} double" for i in range(10)))
        r = T.fit_lorentzians(df, ["obs"], names, [f"e{i}" for i in range(10)], edges, [0.5 * 1.25 ** i for i in range(30)]).first()
        assert r.nu_l == pytest.approx(width, rel=0.3) and r.rms_l == pytest.approx(0.2, rel=0.1)


def test_pooled_with_one_component(spark):
    df = spark.createDataFrame([("A", 0, 0.1), ("A", 1, None)], "c string, draw int, value double")
    p = {r.draw: r.value for r in R.pooled(df, "c", ["draw"], {"A": 1.0}).collect()}
    assert p[0] == pytest.approx(0.1) and p[1] is None


def test_permutation_is_calibrated(spark):
    rng = np.random.default_rng(3)
    low = 0
    for i in range(12):
        df = spark.createDataFrame(pd.DataFrame({"source_id": range(24), "positive": [j % 3 == 0 for j in range(24)], "residual": rng.normal(size=24)}))
        low += R.permutation_test(df, 99, i).first().p < 0.05
    assert low <= 3


def test_conformal_coverage(spark):
    rng = np.random.default_rng(5)
    n = 400
    pos = rng.random(n) < 0.4
    df = spark.createDataFrame(pd.DataFrame({"source_id": range(n), "positive": pos, "score": np.clip(rng.normal(np.where(pos, 0.6, 0.4), 0.15), 0, 1)}))
    s = V.conformal_summary(V.conformal(df, df, 0.2, leave_out=True)).first()
    assert s.coverage_pos >= 0.74 and s.coverage_neg >= 0.74


def test_net_spectrum_and_rebin(spark):
    s = spark.createDataFrame([(1, 100.0, 10.0, 1.0, 1.0)], "ch int, counts double, time double, area double, k double")
    b = spark.createDataFrame([(1, 40.0, 20.0, 2.0)], "ch int, counts double, time double, area double")
    r = P.net_spectrum(s, b, ["ch"], "k").first()
    assert r.net == pytest.approx(10.0 - 0.5 * 2.0)
    c = spark.createDataFrame([("o", 0.0, 2.0, 4.0, 1.0), ("o", 2.0, 4.0, 8.0, 2.0)], "o string, lo double, hi double, v double, e double")
    out = {x.bin: (x.v, x.e) for x in J.fractional_rebin(c, ["o"], "lo", "hi", "v", "e", [0.0, 1.0, 3.0]).collect()}
    assert out[0] == pytest.approx((2.0, 0.5)) and out[1] == pytest.approx((6.0, math.sqrt(0.25 + 1.0)))


def test_interpolation(spark):
    grid = spark.createDataFrame([(0.0, 1.0), (2.0, 5.0), (3.0, 0.0)], "gx double, y double")
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 0.5, 2, 2.5, 3, 9)], "x double")
    want = np.interp([-1, 0, 0.5, 2, 2.5, 3, 9], [0, 2, 3], [1, 5, 0])
    got = J.interp_join(df, "x", grid, "gx", ["y"]).orderBy("x").toPandas()
    assert np.allclose(got.y, want)


def test_ambiguous_extent(spark):
    rng = np.random.default_rng(8)
    m = pd.DataFrame({"key": rng.integers(0, 3, 120), "cls": rng.integers(0, 2, 120), "ra": 50 + rng.random(120) * 3, "dec": 60 + rng.random(120) * 2, "id": range(120)})
    got = J.ambiguous(spark.createDataFrame(m), "key", "cls", "ra", "dec", 1.0, "id").toPandas().set_index("key").extent
    for k, g in m.groupby("key"):
        v = np.c_[np.cos(np.radians(g.dec)) * np.cos(np.radians(g.ra)), np.cos(np.radians(g.dec)) * np.sin(np.radians(g.ra)), np.sin(np.radians(g.dec))]
        assert got[k] == pytest.approx(np.degrees(np.arccos(np.clip(v @ v.T, -1, 1))).max(), abs=1e-6)


def test_cone_join_all_over_the_sphere(spark):
    rng = np.random.default_rng(9)
    n = 400
    d = pd.DataFrame({"id": range(n), "ra": rng.random(n) * 360, "dec": np.degrees(np.arcsin(rng.uniform(-1, 1, n)))})
    d.loc[:20, "dec"] = 89.0 + rng.random(21)
    d.loc[21:30, "ra"] = [0.0, 359.9, 0.1, 359.5, 0.4, 359.99, 0.02, 1.0, 358.9, 0.0]
    df = spark.createDataFrame(d)
    v = np.c_[np.cos(np.radians(d.dec)) * np.cos(np.radians(d.ra)), np.cos(np.radians(d.dec)) * np.sin(np.radians(d.ra)), np.sin(np.radians(d.dec))]
    sep = np.degrees(np.arccos(np.clip(v @ v.T, -1, 1)))
    for tol in (1.5, 12.0):
        got = {(r.l_id, r.r_id) for r in J.cone_join(df, df, tol).select("l_id", "r_id").collect()}
        assert got == {(i, j) for i in range(n) for j in range(n) if sep[i, j] <= tol or i == j}
    near = {r.l_id: r.r_id for r in J.nearest(df.where("id < 200"), df.where("id >= 200"), 9.0).collect()}
    for i in range(200):
        j = 200 + sep[i, 200:].argmin()
        assert near.get(i) == (j if sep[i, j] <= 9.0 else None)


def test_small_groups_are_sampled_whole(spark):
    rows = spark.createDataFrame([(g, i, n) for g, n in (("a", 3), ("b", 500)) for i in range(n)], "g string, idx long, n long")
    s = S.sample_k(rows, "g", "idx", "n", 4, [2, 5], 1).toPandas()
    size = s.groupby(["draw", "k", "g"]).idx.nunique()
    assert all(v == (min(k, 3) if g == "a" else k) for (_, k, g), v in size.items())
    assert len(s) == size.sum()


def test_angles_and_states(spark):
    r = spark.range(1).select(C.sep_deg(F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(90.0)).alias("a"), C.two_threshold_state(F.lit(None).cast("double"), 0.1, 0.2).alias("s")).first()
    assert r.a == pytest.approx(90.0) and r.s == "unknown"


def test_sample_does_not_depend_on_other_sizes(spark):
    rows = spark.range(50).select(F.lit("g").alias("g"), F.col("id").alias("idx"), F.lit(50).cast("long").alias("n"))
    few = rows.unionByName(spark.range(3).select(F.lit("h").alias("g"), F.col("id").alias("idx"), F.lit(3).cast("long").alias("n")))
    one = {(r.draw, r.g): r.idx for r in S.sample_k(few, "g", "idx", "n", 8, [1], 3).collect()}
    more = S.sample_k(few, "g", "idx", "n", 8, [1, 20], 3).collect()
    assert {(r.draw, r.g): r.idx for r in more if r.k == 1} == one
    assert all(len({r.idx for r in more if (r.draw, r.g, r.k) == (d, "h", 20)}) == 3 for d in range(8))


def test_interpolation_of_null_and_repeated_points(spark):
    grid = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (1.0, 10.0), (2.0, 20.0)], "gx double, y double")
    d = spark.createDataFrame([(0, None), (1, 0.5), (2, 1.0), (3, 1.5), (4, -1.0), (5, 9.0)], "id long, x double")
    got = {r.id: r.y for r in J.interp_join(d, "x", grid, "gx", ["y"]).collect()}
    assert got == {0: None, 1: 5.0, 2: 10.0, 3: 15.0, 4: 0.0, 5: 20.0}


def test_replacement_rounds(spark):
    ranks = {1: ([1, 2, 16], [1, 16]), 2: ([1, 2], [1]), 3: ([1, 2, 5, 11], [1, 11]), 4: ([1, 2, 3, 4], [1])}
    last = {1: 30, 2: 2, 3: 30, 4: 30}
    rows = [(k, r, r in g, r in c) for k, (g, c) in ranks.items() for r in range(1, last[k] + 1)]
    cands = spark.createDataFrame(rows, "bin int, rank int, g boolean, c boolean")
    acc = cands.where("rank = 1").select("bin", "rank")
    got = {r.bin: (r.status, r.new_rank) for r in S.replacements(acc, cands, ["bin"], "rank", F.col("g"), F.col("c")).collect()}
    assert got == {1: ("not clean", None), 2: ("no candidate", None), 3: ("replaced", 11), 4: ("not clean", None)}


def test_a_repeated_key_raises_whatever_is_read(spark):
    left, right = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    for columns in (["id"], ["id", "v"]):
        with pytest.raises(Exception, match="duplicate key"):
            J.join_unique(left, right, ["id"]).select(*columns).collect()


def test_short_lines_and_nan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2.5 x\n2\n3 nan y\n")
    got = [tuple(r) for r in read_spaced(spark, str(tmp_path), {"a": "int", "b": "double", "c": "string"}).orderBy("a").collect()]
    assert got == [(1, 2.5, "x"), (2, None, None), (3, None, "y")]


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        own_folder("spark://host:7077")
    assert own_folder("local[2]").startswith("/tmp/")

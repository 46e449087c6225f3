"""Group-held-out models on the embedding vectors (source = vec_id % 20) and the line-item scores."""

from pyspark.sql import functions as F

from tidewatch.functions.columns import expit
from tidewatch.operators import aggregate as A
from tidewatch.operators import evaluate as V
from tidewatch.operators import gramian as G
from tidewatch.operators import knn as K
from tidewatch.operators import models as M
from tidewatch.operators import ordered as O
from tidewatch.plans.evaluate import ST, tables
from tidewatch.plans.registry import query
from tidewatch.plans.views import SCORES, round_all, scores, vectors
from tidewatch.session import cut
from tidewatch.sources import files
from tidewatch.sources.tables import table

FEATURES = ["f1", "f2", "f3"]


def rows(spark, sf, folds=4):
    v = vectors(spark, sf)
    cols = [F.element_at("x", i).alias(f"f{i}") for i in (1, 2, 3)]
    return v.select(F.col("vec_id").alias("id"), "source_id", "positive", "label", *cols, (F.col("source_id") % folds).cast("int").alias("fold"))


ROWS = """vr AS (SELECT vec_id AS id, vec_id % 20 AS source_id, label < 3 AS positive, label, embedding[1]::DOUBLE AS f1, embedding[2]::DOUBLE AS f2, embedding[3]::DOUBLE AS f3, (vec_id % 20 % 4)::INTEGER AS fold FROM embeddings)"""


@query("j19_knn_join", f"""WITH {ROWS}, s AS (SELECT *, (f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER () AS z1, (f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER () AS z2 FROM vr),
  p AS (SELECT a.id, b.id AS r_id, sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)) AS dist FROM s a JOIN s b ON a.source_id <> b.source_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, r_id)::INTEGER AS rank FROM p) SELECT id, rank, r_id, round(dist, 6) AS dist FROM r WHERE rank <= 25""")
def j19(spark, sf):
    s = cut(A.standardise(rows(spark, sf), [], ["f1", "f2"]))
    return round_all(K.knn_join(s, s, ["f1_z", "f2_z"], 25, "source_id"))


@query("e15_knn_residual", f"""WITH {ROWS}, s AS (SELECT *, (f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER () AS z1, (f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER () AS z2 FROM vr),
  p AS (SELECT a.id, a.source_id, a.f3, b.f3 AS nf, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)), b.id) AS rank FROM s a JOIN s b ON a.source_id <> b.source_id),
  m AS (SELECT id, source_id, max(f3) - avg(nf) AS residual FROM p WHERE rank <= 25 GROUP BY 1, 2) SELECT source_id, round(avg(residual), 6) AS residual FROM m GROUP BY 1""")
def e15(spark, sf):
    s = cut(A.standardise(rows(spark, sf), [], ["f1", "f2"]))
    r = K.knn_residual(s, ["f1_z", "f2_z"], "f3", "source_id", 25)
    return round_all(r.groupBy("source_id").agg(F.avg("residual").alias("residual")))


@query("m1_group_folds", f"""WITH {SCORES}, g AS (SELECT source_id, count(*) AS n_test, sum((positive)::INTEGER) AS p FROM oof GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY source_id) - 1)::BIGINT AS fold, source_id, n_test, (sum(n_test) OVER () - n_test)::BIGINT AS n_train, (sum(p) OVER () - p)::BIGINT AS train_pos,
  (sum(n_test) OVER () - n_test - (sum(p) OVER () - p))::BIGINT AS train_neg, sum(p) OVER () - p > 0 AND sum(n_test) OVER () - n_test - (sum(p) OVER () - p) > 0 AS both_classes FROM g""")
def m1(spark, sf):
    return M.fold_checks(scores(spark, sf), "source_id")


@query("m3_stratified_folds", f"""WITH {SCORES} SELECT obs_id, ((row_number() OVER (PARTITION BY positive ORDER BY md5(concat_ws(':', 3, obs_id)), obs_id) - 1) % 5)::INTEGER AS fold FROM oof""")
def m3(spark, sf):
    return M.stratified_folds(scores(spark, sf), "positive", "obs_id", 5, 3).select("obs_id", "fold")


@query("m3_balanced_group_folds", f"""WITH {SCORES}, g AS (SELECT source_id, count(*) AS n FROM oof GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source_id) - 1 AS i FROM g)
  SELECT source_id, n, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INTEGER AS fold FROM r""")
def m3b(spark, sf):
    return M.balanced_group_folds(scores(spark, sf), "source_id", 5)


@query("m4_balanced_weights", f"""WITH {SCORES} SELECT obs_id, round(count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY positive)), 9) AS weight FROM oof""")
def m4(spark, sf):
    return round_all(M.balanced_weights(scores(spark, sf)).select("obs_id", "weight"), 9)


@query("m5_source_equal_weights", f"""WITH {SCORES}, s AS (SELECT positive, count(DISTINCT source_id) AS s FROM oof GROUP BY 1), n AS (SELECT source_id, count(*) AS n FROM oof GROUP BY 1), t AS (SELECT count(*) AS t FROM oof)
  SELECT obs_id, round(t / (2e0 * s * n), 9) AS weight, round(1 / (s * n)::DOUBLE, 9) AS within FROM oof JOIN s USING (positive) JOIN n USING (source_id), t""")
def m5(spark, sf):
    s = M.source_equal_weights(scores(spark, sf), "source_id")
    w = M.source_equal_weights(s.withColumnRenamed("weight", "first"), "source_id", within_class=True)
    return round_all(w.select("obs_id", F.col("first").alias("weight"), F.col("weight").alias("within")), 9)


@query("m6_median_fill", f"""WITH {ROWS}, g AS (SELECT id, fold, CASE WHEN id % 7 <> 0 THEN f1 END AS f1, CASE WHEN id % 5 <> 0 THEN f2 END AS f2 FROM vr),
  m AS (SELECT t.fold, median(g.f1) AS m1, median(g.f2) AS m2 FROM (SELECT DISTINCT fold FROM g) t JOIN g ON g.fold <> t.fold GROUP BY 1)
  SELECT id, round(coalesce(f1, m1), 9) AS f1, round(coalesce(f2, m2), 9) AS f2, (f1 IS NULL OR f2 IS NULL)::INTEGER AS any_missing FROM g JOIN m USING (fold)""")
def m6(spark, sf):
    r = rows(spark, sf).select("id", "fold", F.when(F.col("id") % 7 != 0, F.col("f1")).alias("f1"), F.when(F.col("id") % 5 != 0, F.col("f2")).alias("f2"))
    return round_all(M.median_fill(r, "fold", ["f1", "f2"], 4).select("id", "f1", "f2", "any_missing"), 9)


@query("m6_column_indicators", f"""WITH {ROWS}, g AS (SELECT id, fold, CASE WHEN id % 7 <> 0 THEN f1 END AS f1, CASE WHEN id % 5 <> 0 THEN f2 END AS f2 FROM vr),
  m AS (SELECT t.fold, median(g.f1) AS m1, median(g.f2) AS m2 FROM (SELECT DISTINCT fold FROM g) t JOIN g ON g.fold <> t.fold GROUP BY 1)
  SELECT id, round(coalesce(f1, m1), 9) AS f1, round(coalesce(f2, m2), 9) AS f2, (f1 IS NULL)::INTEGER AS f1_missing, (f2 IS NULL)::INTEGER AS f2_missing FROM g JOIN m USING (fold)""")
def m6_columns(spark, sf):
    r = rows(spark, sf).select("id", "fold", F.when(F.col("id") % 7 != 0, F.col("f1")).alias("f1"), F.when(F.col("id") % 5 != 0, F.col("f2")).alias("f2"))
    return round_all(M.median_fill(r, "fold", ["f1", "f2"], 4, each=True).select("id", "f1", "f2", "f1_missing", "f2_missing"), 9)


@query("m11_knn_classifier", f"""WITH {ROWS}, p AS (SELECT a.id, a.source_id, b.positive AS bp, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2)), b.id) AS rank
  FROM vr a JOIN vr b ON a.source_id <> b.source_id), q AS (SELECT id, source_id, avg(bp::INTEGER) AS q FROM p WHERE rank <= 15 GROUP BY ALL),
  g AS (SELECT source_id, count(*) AS n, sum(positive::INTEGER) AS p FROM vr GROUP BY 1), t AS (SELECT source_id, (sum(p) OVER () - p) / (sum(n) OVER () - n)::DOUBLE AS pi FROM g)
  SELECT id, round((q / pi) / nullif(q / pi + (1 - q) / (1 - pi), 0), 9) AS score FROM q JOIN t USING (source_id)""")
def m11(spark, sf):
    return round_all(M.knn_scores(cut(rows(spark, sf)), ["f1", "f2"], 15, "source_id", "id").select("id", "score"), 9)


def qda_sql():
    parts = []
    for c, cond in ((1, "b.positive"), (0, "NOT b.positive")):
        parts.append(f"avg(CASE WHEN {cond} THEN b.f1 END) AS mx{c}, avg(CASE WHEN {cond} THEN b.f2 END) AS my{c}, 0.9e0 * var_samp(CASE WHEN {cond} THEN b.f1 END) + 0.1e0 AS a{c}, "
                     f"0.9e0 * covar_samp(CASE WHEN {cond} THEN b.f1 END, CASE WHEN {cond} THEN b.f2 END) AS b{c}, 0.9e0 * var_samp(CASE WHEN {cond} THEN b.f2 END) + 0.1e0 AS d{c}")
    f = ", ".join(f"-0.5e0 * ((d{c} * (f1 - mx{c}) * (f1 - mx{c}) - 2 * b{c} * (f1 - mx{c}) * (f2 - my{c}) + a{c} * (f2 - my{c}) * (f2 - my{c})) / (a{c} * d{c} - b{c} * b{c}) + ln(a{c} * d{c} - b{c} * b{c})) AS l{c}" for c in (1, 0))
    return f"""m AS (SELECT t.source_id, {', '.join(parts)} FROM (SELECT DISTINCT source_id FROM vr) t JOIN vr b ON b.source_id <> t.source_id GROUP BY 1), l AS (SELECT id, {f} FROM vr JOIN m USING (source_id))"""


@query("m12_quadratic_discriminant", f"WITH {ROWS}, {qda_sql()} SELECT id, round(1 / (1 + exp(l0 - l1)), 8) AS score FROM l")
def m12(spark, sf):
    return round_all(M.quadratic_scores(rows(spark, sf), "f1", "f2", "source_id", 0.1).select("id", "score"), 8)


@query("m14_prior_scorer", f"""WITH {SCORES}, g AS (SELECT source_id, count(*) AS n, sum(positive::INTEGER) AS p FROM oof GROUP BY 1)
  SELECT source_id, round((sum(p) OVER () - p) / (sum(n) OVER () - n)::DOUBLE, 9) AS score FROM g""")
def m14(spark, sf):
    return round_all(M.prior_scores(scores(spark, sf), "source_id"), 9)


@query("m16_threshold_choice", f"""WITH {ST}, u AS (SELECT DISTINCT model, score AS u FROM tb), c AS (SELECT model, CASE WHEN lag(u) OVER w IS NULL THEN u - 1e-9 ELSE (lag(u) OVER w + u) / 2 END AS t FROM u WINDOW w AS (PARTITION BY model ORDER BY u)
  UNION ALL SELECT model, max(u) + 1e-9 FROM u GROUP BY 1), b AS (SELECT c.model, t, (avg(CASE WHEN positive THEN (score >= t)::INTEGER END) + avg(CASE WHEN NOT positive THEN (score < t)::INTEGER END)) / 2 AS ba FROM c JOIN tb USING (model) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(ba, 12) DESC, abs(t - 0.5), t) AS rn FROM b) SELECT model, round(t, 10) AS threshold, round(ba, 9) AS balanced_accuracy FROM r WHERE rn = 1""")
def m16(spark, sf):
    t = M.best_threshold(tables(spark, sf), ["model"])
    return t.select("model", F.round("threshold", 10).alias("threshold"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


WLS = """w AS (SELECT vr.*, 1e0 / (s.s * n.n) AS w FROM vr JOIN (SELECT positive, count(DISTINCT source_id) AS s FROM vr GROUP BY 1) s USING (positive) JOIN (SELECT positive, source_id, count(*) AS n FROM vr GROUP BY 1, 2) n USING (positive, source_id)),
  s AS (SELECT positive, sum(w) AS s0, sum(w*f1) AS sa, sum(w*f2) AS sb, sum(w*f1*f1) AS saa, sum(w*f1*f2) AS sab, sum(w*f2*f2) AS sbb, sum(w*f3) AS sy, sum(w*f1*f3) AS say, sum(w*f2*f3) AS sby FROM w GROUP BY 1),
  e AS (SELECT *, saa - sa*sa/s0 AS ca, sbb - sb*sb/s0 AS cb, sab - sa*sb/s0 AS cab, say - sa*sy/s0 AS cy, sby - sb*sy/s0 AS dy FROM s),
  f AS (SELECT *, (cy*cb - dy*cab)/(ca*cb - cab*cab) AS b1, (dy*ca - cy*cab)/(ca*cb - cab*cab) AS b2 FROM e), h AS (SELECT positive, (sy - b1*sa - b2*sb)/s0 AS b0, b1, b2 FROM f),
  v AS (SELECT positive, greatest(0.01e0, sqrt(sum(w * pow(f3 - b0 - b1*f1 - b2*f2, 2)) / sum(w))) AS sg FROM w JOIN h USING (positive) GROUP BY 1), hv AS (SELECT * FROM h JOIN v USING (positive))"""


def planes(df):
    w = M.source_equal_weights(df, "source_id", within_class=True)
    p = {r["positive"]: r for r in A.weighted_plane(w, ["positive"], "f3", "f1", "f2", "weight", floor=0.01).collect()}
    return {c: [p[c][f"beta{i}"] for i in range(3)] for c in p}, {c: p[c]["sigma"] for c in p}


@query("m21_timing_log_ratio", f"""WITH {ROWS}, {WLS}, z AS (SELECT id, a.sg AS s1, b.sg AS s0, (f3 - a.b0 - a.b1*f1 - a.b2*f2) / a.sg AS z1, (f3 - b.b0 - b.b1*f1 - b.b2*f2) / b.sg AS z0 FROM vr, (SELECT * FROM hv WHERE positive) a, (SELECT * FROM hv WHERE NOT positive) b)
  SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE round(-ln(s1 / s0) - 2.5e0 * (ln(1 + z1*z1/4) - ln(1 + z0*z0/4)), 5) END AS llr FROM z""")
def m21(spark, sf):
    r = rows(spark, sf)
    b, s = planes(r)
    r = r.withColumn("f3", F.when(F.col("id") % 9 != 0, F.col("f3")))
    return round_all(r.select("id", M.t_log_ratio(r, b, s, "f3", "f1", "f2").alias("llr")), 5)


@query("m22_frozen_cut", """WITH r AS (SELECT vec_id % 20 AS source_id, label < 3 AS positive, abs(embedding[1]::DOUBLE) + 0.01e0 AS nu FROM embeddings), c AS (SELECT sqrt(median(CASE WHEN positive THEN nu END) * median(CASE WHEN NOT positive THEN nu END)) AS cut FROM r)
  SELECT round(max(cut), 9) AS cut, round(avg(CASE WHEN positive THEN (nu < cut)::INTEGER END), 9) AS sensitivity, round(avg(CASE WHEN NOT positive THEN (nu >= cut)::INTEGER END), 9) AS specificity FROM r, c""")
def m22(spark, sf):
    r = vectors(spark, sf).select("source_id", "positive", F.element_at("rate", 1).alias("nu"))
    med = {x["positive"]: x["m"] for x in O.percentiles(r, ["positive"], "nu", {"m": 0.5}).collect()}
    cut_at = M.geometric_cut((med[True], med[False]))
    c = V.confusion(r, [], F.col("nu") < cut_at)
    return round_all(c.select(F.lit(cut_at).alias("cut"), "sensitivity", "specificity"), 9)


@query("m23_detection_rule", """WITH g AS (SELECT user_id, user_id % 5 = 0 AS positive, value - 45 AS x, 5e0 + event_id % 7 AS s FROM events), z AS (SELECT user_id, bool_or(positive) AS positive, sum(x / (s * s)) / sqrt(sum(1 / (s * s))) AS z FROM g GROUP BY 1)
  SELECT positive, z > 3 AS detected, count(*) AS n FROM z GROUP BY 1, 2""")
def m23(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("user_id") % 5 == 0).alias("positive"), (F.col("value") - 45).alias("x"), (F.col("event_id") % 7 + 5).cast("double").alias("s"))
    return A.inverse_variance_mean(e, ["user_id", "positive"], "x", "s").groupBy("positive", "detected").agg(F.count(F.lit(1)).alias("n"))


# ---- iterative fits: rows-only checks here, brute force in the tests ----

def whole(spark, sf):
    """Whole vectors, one fold per source."""
    v = vectors(spark, sf)
    return v.select(F.col("vec_id").alias("id"), "source_id", "positive", "x", F.col("source_id").cast("int").alias("fold"))


#: One row per fold: a fit that is at its optimum has no gradient.
STATIONARY = """SELECT a.s::INTEGER AS fold, count(*) AS n_train, 0.0::DOUBLE AS gradient FROM (SELECT DISTINCT vec_id % 20 AS s FROM embeddings) a JOIN embeddings b ON b.vec_id % 20 <> a.s GROUP BY 1"""


def stationary(train, params, weight=None):
    flat = G.stationarity(train, params, "fold", "x", 1.0, weight)
    return flat.select(F.col("model").cast("int").alias("fold"), "n_train", F.round("gradient", 6).alias("gradient"))


@query("m2_held_out_logit")
def m2(spark, sf):
    return G.held_out(whole(spark, sf), "fold", "x")[0].select("id", "source_id", "positive", "score")


@query("m2_stationarity", STATIONARY)
def m2_stationarity(spark, sf):
    d = whole(spark, sf)
    return stationary(d, G.held_out(d, "fold", "x")[1])


@query("m7_logistic_weighted")
def m7(spark, sf):
    d = M.source_equal_weights(whole(spark, sf), "source_id", within_class=True)
    return G.held_out(d, "fold", "x", weight="weight")[0].select("id", "source_id", "positive", "score")


@query("m7_stationarity", STATIONARY)
def m7_stationarity(spark, sf):
    d = cut(M.source_equal_weights(whole(spark, sf), "source_id", within_class=True))
    return stationary(d, G.held_out(d, "fold", "x", weight="weight")[1], "weight")


@query("m8_random_forest")
def m8(spark, sf):
    return M.held_out_ml(rows(spark, sf, 2), "fold", 2, ["f1", "f2"], M.forest(trees=20, n_features=2, depth=10)).select("id", "source_id", "positive", "score")


@query("m9_boosted_trees")
def m9(spark, sf):
    return M.held_out_ml(rows(spark, sf, 2), "fold", 2, FEATURES, M.boosted(iterations=5)).select("id", "source_id", "positive", "score")


@query("m10_kernel_margin")
def m10(spark, sf):
    return M.held_out_ml(rows(spark, sf, 2), "fold", 2, ["f1", "f2"], M.kernel_margin(["f1", "f2"], 16, max_iter=15)).select("id", "source_id", "positive", "score")


@query("m13_small_network")
def m13(spark, sf):
    return M.held_out_ml(rows(spark, sf, 2), "fold", 2, FEATURES, M.perceptron([3, 4, 2], [1, 2], 20)).select("id", "source_id", "positive", "score")


@query("m15_nested_selection")
def m15(spark, sf):
    chosen, oof = M.nested_selection(rows(spark, sf), "fold", 4, FEATURES, [0.01, 1.0, 100.0], "source_id")
    return oof.join(chosen.select(F.col("outer").alias("fold"), "config", F.col("auc").alias("inner_auc")), "fold").select("id", "fold", "config", "inner_auc", "threshold", "raw_score", "score")


@query("m17_frozen_model")
def m17(spark, sf):
    r = rows(spark, sf)
    path = M.freeze(r.where("source_id < 10"), FEATURES, files.scratch(spark, "model"))
    return M.score_frozen(r.where("source_id >= 10"), path).select("id", "source_id", "positive", "score")


@query("m17_source_excluded")
def m17_source_excluded(spark, sf):
    """Frozen on ten sources; each of these is scored by the fit without it, all others by the fit of all ten."""
    d = whole(spark, sf)
    train = d.where("source_id < 10")
    fits = G.fit_vectors(train, "fold", "x", [M.Task("all", ()), *[M.Task(str(k), (k,)) for k in range(10)]])
    return G.scored(d, G.parameters(d, fits), F.when(F.col("source_id") < 10, F.col("fold").cast("string")).otherwise("all"), "x").select("id", "source_id", "positive", "score")


@query("m18_augmented_training")
def m18(spark, sf):
    d = whole(spark, sf)
    return G.held_out(d.where("source_id < 12"), "fold", "x", extra=d.where("source_id >= 12"))[0].select("id", "source_id", "positive", "score")


@query("m19_candidate_table")
def m19(spark, sf):
    d = whole(spark, sf)
    fits = G.fit_vectors(d.where("source_id < 15"), "fold", "x", [M.Task("all", ())])
    c = G.scored(d.where("source_id >= 15"), G.parameters(d, fits), F.lit("all"), "x")
    g = c.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return g.join(O.percentiles(c, ["source_id"], "score", {"median": 0.5}), "source_id")


@query("m20_repeated_three_class")
def m20(spark, sf):
    r = rows(spark, sf).withColumn("cls", (F.col("label") % 3).cast("double"))
    return M.repeated_three_class(r, FEATURES, "cls", "source_id", 3, 15, "id", 11)


@query("m21_conditional_score")
def m21b(spark, sf):
    r = cut(rows(spark, sf))
    fits = M.fit_logits(r, "fold", ["f1", "f2"], [M.Task(str(k), (k,)) for k in range(4)])
    out = None
    for k in range(4):
        b, s = planes(r.where(F.col("fold") != k))
        t = r.where(F.col("fold") == k).withColumn("f3", F.when(F.col("id") % 9 != 0, F.col("f3")))
        t = t.withColumn("score", expit(M.logit_column(fits[str(k)], ["f1", "f2"]) + M.t_log_ratio(t, b, s, "f3", "f1", "f2")))
        out = t if out is None else out.unionByName(t)
    return out.select("id", "source_id", "positive", "score")


@query("m24_ablation_set")
def m24(spark, sf):
    """Each element alone, each with the first one as nuisance, and all, each held out by source."""
    d = cut(whole(spark, sf))
    sets = {f"x{i}": (i,) for i in range(64)} | {f"x0+x{i}": (0, i) for i in range(1, 64)} | {"all": None}
    folds = range(20)
    params = cut(G.parameters(d, G.fit_vectors(d, "fold", "x", [M.Task(f"{n}.{k}", (k,), 1.0, u) for n, u in sets.items() for k in folds])))
    p = params.select(F.substring_index("model", ".", 1).alias("model"), F.substring_index("model", ".", -1).cast("int").alias("fold"), "slopes", "intercept")
    oof = d.join(p, "fold").select("source_id", "positive", "model", expit(G.predictor("x", F.col("slopes"), F.col("intercept"))).alias("score"))
    return V.point_metrics(oof, ["model"])

"""Group-held-out models: folds, weights, closed-form scorers and fits for many folds at once.

Fits never loop over rows on the driver: every iteration is one aggregation over the table, whatever the number of folds or settings; only sums
of fixed size per task come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import expit, hash_cell, hash_text
from tidewatch.operators.knn import knn_join
from tidewatch.operators.ordered import attach_row, count_percentiles, row_index, scan
from tidewatch.session import cut, spread

#: Fits whose sums one job gathers.
TASKS_AT_ONCE = 2000


# ---- folds and weights ----

def group_folds(df: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out folds: (group, fold), numbered from 0 in group order."""
    g = df.select(group).distinct()
    return row_index(g, [], group, out="_i").select(group, (F.col("_i") - 1).alias("fold"))


def fold_checks(df: DataFrame, group: str) -> DataFrame:
    """Per fold: test rows, train rows per class, and whether the train side has both classes and no row of the test group."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col("positive").cast("int")).alias("_p")).join(group_folds(df, group), group)
    t = g.agg(F.sum("n_test").alias("_n"), F.sum("_p").alias("_P_all"))
    j = attach_row(g, t)
    pos, n = F.col("_P_all") - F.col("_p"), F.col("_n") - F.col("n_test")
    return j.select("fold", group, "n_test", n.alias("n_train"), pos.alias("train_pos"), (n - pos).alias("train_neg"), ((pos > 0) & (n - pos > 0)).alias("both_classes"))


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int, seed: int) -> DataFrame:
    """Row folds of equal class share (a leak diagnostic: groups are split)."""
    d = df.withColumn("_h", hash_text(seed, F.col(row_id)))
    d = row_index(d, [label], "_h", [row_id], out="_i", cell=hash_cell("_h", 3))
    return d.withColumn("fold", ((F.col("_i") - 1) % k).cast("int")).drop("_h", "_i")


def balanced_group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups dealt to k folds by falling size, back and forth: (group, n, fold)."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_o", -F.col("n"))
    r = row_index(g, [], "_o", [group], out="_i").withColumn("_i", F.col("_i") - 1)
    there = F.col("_i") % k
    fold = F.when(F.floor(F.col("_i") / k) % 2 == 0, there).otherwise(k - 1 - there)
    return r.select(group, "n", fold.cast("int").alias("fold"))


def balanced_weights(df: DataFrame) -> DataFrame:
    """n / (2 n_class); rows without a class are a class of their own. The counts travel to the rows as one row, so no class is gathered in one task."""
    yes = F.col("positive").cast("boolean")
    c = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(yes).alias("_n1"), F.count_if(~yes).alias("_n0"))
    own = F.when(yes, F.col("_n1")).when(~yes, F.col("_n0")).otherwise(F.col("_n") - F.col("_n1") - F.col("_n0"))
    return attach_row(df, c).withColumn("weight", F.col("_n") / (2.0 * own)).drop("_n", "_n1", "_n0")


def source_equal_weights(df: DataFrame, group: str, within_class: bool = False) -> DataFrame:
    """Every source of a class weighs the same: n / (2 S_class n_source), or 1 / (S_class n_source)."""
    s = df.groupBy(group, "positive").agg(F.count(F.lit(1)).alias("_ns"))
    c = s.groupBy("positive").agg(F.count(F.lit(1)).alias("_S"), F.sum("_ns").alias("_nc"))
    c = attach_row(c, c.agg(F.sum("_nc").alias("_n")))
    top = F.lit(1.0) if within_class else F.col("_n") / 2.0
    w = s.join(c, "positive").select(group, "positive", (top / (F.col("_S") * F.col("_ns"))).alias("weight"))
    return df.join(w, [group, "positive"])


def median_fill(df: DataFrame, fold: str, columns: Sequence[str], n_folds: int, each: bool = False) -> DataFrame:
    """Per fold: missing values of test rows filled with the median of the training rows, plus a flag that any was missing and, with each, one flag per column (<column>_missing).

    Medians come from distinct values: their counts are dealt to the folds that train on them, rows are not.
    """
    out = df.withColumn("any_missing", F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)))
    if each:
        out = out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})
    for c in columns:
        v = df.where(F.col(c).isNotNull()).groupBy(fold, F.col(c).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
        others = F.array_except(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.array(F.col(fold).cast("int")))
        t = v.select("_v", "_w", F.explode(others).alias("_f")).groupBy("_f", "_v").agg(F.sum("_w").alias("_w"))
        m = count_percentiles(t, ["_f"], {"_m": 0.5}).select(F.col("_f").cast("long").alias("_f"), "_m")
        out = out.join(m, out[fold].cast("long") == m["_f"], "left").withColumn(c, F.coalesce(F.col(c), F.col("_m"))).drop("_f", "_m")
    return out


# ---- closed-form scorers ----

def prior_scores(df: DataFrame, group: str) -> DataFrame:
    """Class frequency of the training side of each leave-one-group-out fold."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("positive").cast("int")).alias("_p"))
    t = g.agg(F.sum("_n").alias("_N_all"), F.sum("_p").alias("_P_all"))
    return attach_row(g, t).select(group, F.try_divide(F.col("_P_all") - F.col("_p"), F.col("_N_all") - F.col("_n")).alias("score"))


def knn_scores(df: DataFrame, features: Sequence[str], k: int, group: str, row_id: str) -> DataFrame:
    """Share of positive neighbours from other groups, corrected to equal class priors of the training side."""
    n = knn_join(df, df, features, k, group, row_id, row_id, keep=["positive"])
    q = n.groupBy(row_id).agg(F.avg(F.col("r_positive").cast("double")).alias("_q"))
    j = df.select(row_id, group, "positive").join(q, row_id).join(prior_scores(df, group).withColumnRenamed("score", "_pi"), group)
    a, b = F.try_divide(F.col("_q"), F.col("_pi")), F.try_divide(1.0 - F.col("_q"), 1.0 - F.col("_pi"))
    return j.select(row_id, group, "positive", F.try_divide(a, a + b).alias("score"))


def quadratic_scores(df: DataFrame, x: str, y: str, group: str, shrink: float = 0.0) -> DataFrame:
    """Leave-one-group-out quadratic discriminant of two features with equal priors.

    One pass of sums per (group, class); each fold's training moments are the totals minus the group's own sums.
    """
    X, Y = F.col(x), F.col(y)
    parts = {"n": F.lit(1.0), "x": X, "y": Y, "xx": X * X, "xy": X * Y, "yy": Y * Y}
    aggs = [F.sum(F.when(F.col("positive") == c, v).otherwise(0.0)).alias(f"{k}{int(c)}") for c in (True, False) for k, v in parts.items()]
    g = df.groupBy(group).agg(*aggs)
    names = [f"{k}{c}" for c in (1, 0) for k in parts]
    t = g.agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    f = attach_row(g, t).select(group, *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in names])
    j = df.join(f, group)
    logp = {}
    for c in (1, 0):
        n = F.col(f"n{c}")
        mx, my = F.col(f"x{c}") / n, F.col(f"y{c}") / n
        sxx, sxy, syy = [(F.col(f"{k}{c}") - n * a * b) / (n - 1) for k, a, b in (("xx", mx, mx), ("xy", mx, my), ("yy", my, my))]
        sxx, sxy, syy = (1 - shrink) * sxx + shrink, (1 - shrink) * sxy, (1 - shrink) * syy + shrink
        det = sxx * syy - sxy * sxy
        dx, dy = X - mx, Y - my
        logp[c] = -0.5 * ((syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / det + F.log(det))
    return j.select(*df.columns, expit(logp[1] - logp[0]).alias("score"))


def best_threshold(sources: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Cut with the largest source balanced accuracy among the midpoints of sorted scores; ties go to the cut closest to 0.5."""
    p = F.col("positive")
    by = sources.groupBy(*keys, F.col(score).alias("_v")).agg(F.sum(p.cast("long")).alias("_p"), F.sum((~p).cast("long")).alias("_q"))
    s = scan(by, keys, "_v", running={"_pb": ("sum", F.col("_p"), False), "_qb": ("sum", F.col("_q"), False), "_prev": ("last", F.col("_v"), False)},
             totals={"_P_all": ("sum", F.col("_p")), "_Q_all": ("sum", F.col("_q")), "_top": ("max", F.col("_v"))})

    def ba(pb, qb):
        return (F.try_divide(F.col("_P_all") - pb, F.col("_P_all")) + F.try_divide(qb, F.col("_Q_all"))) / 2.0

    below = F.struct(F.when(F.col("_prev").isNull(), F.col("_v") - 1e-9).otherwise((F.col("_prev") + F.col("_v")) / 2.0).alias("t"), ba(F.col("_pb"), F.col("_qb")).alias("ba"))
    above = F.struct((F.col("_v") + 1e-9).alias("t"), ba(F.col("_pb") + F.col("_p"), F.col("_qb") + F.col("_q")).alias("ba"))
    cands = s.select(*keys, F.explode(F.array_compact(F.array(below, F.when(F.col("_v") == F.col("_top"), above)))).alias("c"))
    order = F.struct(-F.round("c.ba", 12), F.abs(F.col("c.t") - 0.5), F.col("c.t"))
    return cands.groupBy(*keys).agg(F.min_by("c", order).alias("c")).select(*keys, F.col("c.t").alias("threshold"), F.col("c.ba").alias("balanced_accuracy"))


def shifted(oof: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Scores moved so that 0.5 is the chosen cut."""
    return oof.join(thresholds.select(*keys, "threshold"), list(keys)).withColumn("score", F.col(score) - F.col("threshold") + 0.5)


def choose_best(cands: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Selected setting per key: larger AUC, then larger balanced accuracy (both to 12 decimals), then grid order."""
    rest = [c for c in cands.columns if c not in keys]
    pos = F.struct(-F.round("auc", 12), -F.round("balanced_accuracy", 12), F.col(order))
    return cands.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_b")).select(*keys, "_b.*")


def geometric_cut(medians: tuple[float, float]) -> float:
    return math.sqrt(medians[0] * medians[1])


# ---- logistic fits for many tasks at once ----

@dataclass(frozen=True)
class Task:
    """One fit: the folds it leaves out, the inverse penalty, and the features it uses (by position)."""

    name: str
    without: tuple[int, ...]
    c: float = 1.0
    use: tuple[int, ...] | None = None


def fit_logits(df: DataFrame, fold: str, features: Sequence[str], tasks: Sequence[Task], weight: str | None = None, tol: float = 1e-9, max_iter: int = 30) -> dict[str, dict]:
    """Standardised logistic regressions with an L2 penalty and class-balanced weights, for all tasks together.

    Newton steps: each is one aggregation by task of gradient and Hessian sums. Rows are not copied through the shuffle, because the tasks are
    expanded inside the map stage and summed there. Objective: |w|^2 / 2 + C sum(weight x log loss), intercept free.
    """
    d = len(features)
    base = df.where(F.lit(True) if not features else sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) == 0)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    base = cut(spread(base.select(F.col(fold).cast("int").alias("_f"), F.col("positive").cast("double").alias("_y"), w.alias("_w"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])))
    sums = base.groupBy("_f", "_y").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), *[x for i in range(d) for x in (F.sum(f"_x{i}").alias(f"s{i}"), F.sum(F.col(f"_x{i}") * F.col(f"_x{i}")).alias(f"q{i}"))]).collect()
    state = {}
    for t in tasks:
        rows = [r for r in sums if r["_f"] not in t.without]
        n = sum(r["n"] for r in rows)
        mean = np.array([sum(r[f"s{i}"] for r in rows) / n for i in range(d)])
        sd = np.sqrt(np.maximum(np.array([sum(r[f"q{i}"] for r in rows) / n for i in range(d)]) - mean ** 2, 0.0))
        use = np.array([t.use is None or i in t.use for i in range(d)])
        cls = {y: n / (2.0 * sum(r["w"] for r in rows if r["_y"] == y)) if any(r["_y"] == y for r in rows) else 0.0 for y in (0.0, 1.0)}
        state[t.name] = dict(task=t, mean=mean, scale=np.where(use & (sd > 0), 1.0 / np.where(sd > 0, sd, 1.0), 0.0), cls=cls, beta=np.zeros(d + 1), done=False)
    for _ in range(max_iter):
        live = [s for s in state.values() if not s["done"]]
        if not live:
            break
        sums_now = [x for at in range(0, len(live), TASKS_AT_ONCE) for x in _newton_sums(base, live[at:at + TASKS_AT_ONCE], d)]
        for s, (grad, hess) in zip(live, sums_now):
            pen = np.r_[0.0, np.ones(d)]
            g = s["task"].c * grad - pen * s["beta"]
            h = s["task"].c * hess + np.diag(pen) + 1e-12 * np.eye(d + 1)
            step = np.linalg.solve(h, g)
            s["beta"] = s["beta"] + step
            s["done"] = bool(np.max(np.abs(step)) < tol)
    late = [k for k, s in state.items() if not s["done"]]
    if late:
        raise RuntimeError(f"{len(late)} fits have not converged in {max_iter} steps, such as {late[0]}")
    return {k: dict(mean=s["mean"], scale=s["scale"], beta=s["beta"], without=s["task"].without) for k, s in state.items()}


def _newton_sums(base: DataFrame, live: Sequence[Mapping], d: int):
    items = [F.struct(F.lit(i).alias("i"), F.array(*[F.lit(f) for f in s["task"].without]).cast("array<int>").alias("o"), F.lit(s["cls"][1.0]).alias("c1"), F.lit(s["cls"][0.0]).alias("c0"),
                      F.array(*[F.lit(float(x)) for x in s["mean"]]).alias("m"), F.array(*[F.lit(float(x)) for x in s["scale"]]).alias("s"), F.array(*[F.lit(float(x)) for x in s["beta"]]).alias("b"))
             for i, s in enumerate(live)]
    e = base.withColumn("_t", F.explode(F.array(*items))).where(~F.array_contains(F.col("_t.o"), F.col("_f")))
    z = [F.lit(1.0)] + [(F.col(f"_x{i}") - F.col("_t.m")[i]) * F.col("_t.s")[i] for i in range(d)]
    e = e.select(F.col("_t.i").alias("_i"), "_y", (F.col("_w") * F.when(F.col("_y") == 1.0, F.col("_t.c1")).otherwise(F.col("_t.c0"))).alias("_w"),
                 *[v.alias(f"_z{i}") for i, v in enumerate(z)], sum((v * F.col("_t.b")[i] for i, v in enumerate(z)), F.lit(0.0)).alias("_eta"))
    p = expit("_eta")
    e = e.withColumns({"_r": F.col("_w") * (F.col("_y") - p), "_h": F.col("_w") * p * (1.0 - p)})
    aggs = [F.sum(F.col("_r") * F.col(f"_z{i}")).alias(f"g{i}") for i in range(d + 1)]
    aggs += [F.sum(F.col("_h") * F.col(f"_z{i}") * F.col(f"_z{k}")).alias(f"h{i}_{k}") for i in range(d + 1) for k in range(i, d + 1)]
    got = {r["_i"]: r for r in e.groupBy("_i").agg(*aggs).collect()}
    for i in range(len(live)):
        r = got.get(i)
        g, h = np.zeros(d + 1), np.zeros((d + 1, d + 1))
        if r is not None:
            g[:] = [r[f"g{a}"] for a in range(d + 1)]
            for a in range(d + 1):
                for b in range(a, d + 1):
                    h[a, b] = h[b, a] = r[f"h{a}_{b}"]
        yield g, h


def logit_column(fit: Mapping, features: Sequence[str]) -> Column:
    """Linear predictor of one fit."""
    out = F.lit(float(fit["beta"][0]))
    for i, f in enumerate(features):
        out = out + F.lit(float(fit["beta"][i + 1])) * (F.col(f) - F.lit(float(fit["mean"][i]))) * F.lit(float(fit["scale"][i]))
    return out


def fold_logit(fits: Mapping[int, Mapping], fold: str, features: Sequence[str]) -> Column:
    """Linear predictor of the fit that belongs to the row's fold, looked up in one literal array."""
    order = sorted(fits)
    b = F.array(*[F.array(*[F.lit(float(x)) for x in fits[k]["beta"]], *[F.lit(float(x)) for x in fits[k]["mean"]], *[F.lit(float(x)) for x in fits[k]["scale"]]) for k in order])
    row = F.element_at(b, F.array_position(F.array(*[F.lit(k) for k in order]), F.col(fold).cast("int")).cast("int"))
    d = len(features)
    out = row[0]
    for i, f in enumerate(features):
        out = out + row[i + 1] * (F.col(f) - row[d + 1 + i]) * row[2 * d + 1 + i]
    return out


def held_out_logit(df: DataFrame, fold: str, n_folds: int, features: Sequence[str], c: float = 1.0, weight: str | None = None, extra: DataFrame | None = None,
                   use: Sequence[int] | None = None) -> DataFrame:
    """Out-of-fold probabilities. extra: rows that are added to the training side of every fold only."""
    train = df if extra is None else df.unionByName(extra.withColumn(fold, F.lit(-1).cast(df.schema[fold].dataType)), allowMissingColumns=True)
    u = None if use is None else tuple(use)
    fits = fit_logits(train, fold, features, [Task(str(k), (k,), c, u) for k in range(n_folds)], weight)
    return df.withColumn("score", expit(fold_logit({k: fits[str(k)] for k in range(n_folds)}, fold, features)))


def nested_selection(df: DataFrame, fold: str, n_folds: int, features: Sequence[str], grid: Sequence[float], group: str) -> tuple[DataFrame, DataFrame]:
    """Choose the penalty inside every outer fold by inner held-out source AUC, then score the outer test rows.

    All (outer, inner, setting) fits run as one batch. Returns the selection table and the out-of-fold scores.
    """
    from tidewatch.operators.evaluate import auc

    folds = range(n_folds)
    tasks = [Task(f"{o}.{i}.{g}", (o, i), c) for o in folds for i in folds if i != o for g, c in enumerate(grid)]
    fits = fit_logits(df, fold, features, tasks)
    scored = []
    for o in folds:
        for g in range(len(grid)):
            s = expit(fold_logit({i: fits[f"{o}.{i}.{g}"] for i in folds if i != o}, fold, features))
            scored.append(F.struct(F.lit(o).alias("outer"), F.lit(g).alias("config"), F.when(F.col(fold) != o, s).alias("score")))
    inner = df.select(group, "positive", F.explode(F.array(*scored)).alias("s")).select(group, "positive", "s.*").where("score is not null")
    src = cut(inner.groupBy("outer", "config", group).agg(F.max("positive").alias("positive"), F.avg("score").alias("score")))
    cands = auc(src, ["outer", "config"], n_cells=0).join(best_threshold(src, ["outer", "config"]), ["outer", "config"])
    chosen = cut(choose_best(cands, ["outer"], "config"))
    picks = {r["outer"]: (r["config"], r["threshold"]) for r in chosen.collect()}
    outer = fit_logits(df, fold, features, [Task(str(o), (o,), grid[picks[o][0]]) for o in folds])
    s = expit(fold_logit({o: outer[str(o)] for o in folds}, fold, features))
    t = F.element_at(F.array(*[F.lit(float(picks[o][1])) for o in folds]), F.col(fold).cast("int") + 1)
    return chosen, df.withColumns({"raw_score": s, "threshold": t}).withColumn("score", F.col("raw_score") - F.col("threshold") + 0.5)


# ---- Spark ML estimators ----

def held_out_ml(df: DataFrame, fold: str, n_folds: int, features: Sequence[str], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Out-of-fold scores of any estimator: one distributed fit per fold; ``fit`` returns a function that adds ``score``."""
    v = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df).withColumn("_y", F.col("positive").cast("double"))
    v = cut(v)
    out = None
    for k in range(n_folds):
        train = balanced_weights(v.where(F.col(fold) != k))
        s = fit(train)(v.where(F.col(fold) == k)).select(*df.columns, "score")
        out = s if out is None else out.unionByName(s)
    return out


def _probability(model):
    return lambda d: model.transform(d).withColumn("score", vector_to_array("probability")[1])


def forest(trees: int = 500, seed: int = 42, n_features: int = 2, depth: int = 30):
    subset = str(max(1, int(math.sqrt(n_features))))
    est = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="weight", numTrees=trees, minInstancesPerNode=2, maxDepth=depth, featureSubsetStrategy=subset, seed=seed)
    return lambda train: _probability(est.fit(train))


def boosted(iterations: int = 200, step: float = 0.1, seed: int = 42):
    est = GBTClassifier(featuresCol="_v", labelCol="_y", weightCol="weight", maxIter=iterations, stepSize=step, maxDepth=4, seed=seed)
    return lambda train: _probability(est.fit(train))


def perceptron(layers: Sequence[int], seeds: Sequence[int], max_iter: int = 100):
    """Small network averaged over seeds. The estimator takes no weights, so rows of the rarer class are repeated to balance the classes."""
    def fit(train):
        n = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
        top = max(n.values())
        copies = F.when(F.col("_y") == 1.0, round(top / n.get(1.0, top))).otherwise(round(top / n.get(0.0, top)))
        rows = cut(train.withColumn("_i", F.explode(F.sequence(F.lit(1), copies.cast("int")))))
        models = [MultilayerPerceptronClassifier(featuresCol="_v", labelCol="_y", layers=list(layers), seed=s, maxIter=max_iter).fit(rows) for s in seeds]

        def score(d):
            keep = d.columns
            total = F.lit(0.0)
            for i, m in enumerate(models):
                d = m.transform(d).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
                total = total + F.col(f"_p{i}")
            return d.withColumn("score", total / len(models)).select(*keep, "score")

        return score

    return fit


def kernel_margin(features: Sequence[str], n_random: int = 64, gamma_factor: float = 1.0, reg: float = 0.01, seed: int = 42, max_iter: int = 50):
    """Margin classifier in random Fourier features of an RBF kernel; score = sigmoid of the margin. gamma = factor / (d x variance)."""
    d = len(features)
    rng = np.random.default_rng(seed)
    w0, b0 = rng.normal(size=(n_random, d)), rng.uniform(0, 2 * math.pi, n_random)

    def fit(train):
        stats = train.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
        mean = [stats[f"m_{f}"] for f in features]
        sd = [stats[f"s_{f}"] or 1.0 for f in features]
        w = w0 * math.sqrt(2.0 * gamma_factor / d)

        def lift(df):
            z = [(F.col(f) - mean[i]) / sd[i] for i, f in enumerate(features)]
            cols = {f"_c{k}": F.cos(sum((z[i] * float(w[k, i]) for i in range(d)), F.lit(float(b0[k])))) * math.sqrt(2.0 / n_random) for k in range(n_random)}
            return VectorAssembler(inputCols=list(cols), outputCol="_rf").transform(df.withColumns(cols)).drop(*cols)

        model = LinearSVC(featuresCol="_rf", labelCol="_y", weightCol="weight", regParam=reg, maxIter=max_iter).fit(lift(train))
        return lambda df: model.transform(lift(df)).withColumn("score", expit(vector_to_array("rawPrediction")[1]))

    return fit


def freeze(df: DataFrame, features: Sequence[str], path: str, c: float = 1.0) -> str:
    """Fit once on all rows and save the fitted stages."""
    d = balanced_weights(df.withColumn("_y", F.col("positive").cast("double")))
    total = d.agg(F.sum("weight")).first()[0]
    stages = [VectorAssembler(inputCols=list(features), outputCol="_v"),
              LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0)]
    Pipeline(stages=stages).fit(d).write().overwrite().save(path)
    return path


def score_frozen(df: DataFrame, path: str) -> DataFrame:
    model = PipelineModel.load(path)
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def repeated_three_class(df: DataFrame, features: Sequence[str], cls: str, group: str, runs: int, cap: int, row_id: str, seed: int) -> DataFrame:
    """Repeated capped subsamples: mean class probability per source and run, then median, deviation over runs and the leading class."""
    from tidewatch.operators.select import capped

    v = cut(VectorAssembler(inputCols=list(features), outputCol="_v").transform(df))
    per = None
    for r in range(runs):
        train = capped(v, [group], cap, row_id, seed + r)
        m = LogisticRegression(featuresCol="_v", labelCol=cls, family="multinomial", regParam=0.001).fit(train)
        p = m.transform(v).select(group, vector_to_array("probability").alias("_p"))
        g = p.groupBy(group).agg(*[F.avg(F.col("_p")[i]).alias(f"p{i}") for i in range(3)]).withColumn("run", F.lit(r))
        per = g if per is None else per.unionByName(g)
    g = per.groupBy(group).agg(*[x for i in range(3) for x in (F.percentile(f"p{i}", F.lit(0.5)).alias(f"p{i}"), F.stddev_pop(f"p{i}").alias(f"sd{i}"))])
    lead = F.array_sort(F.array(*[F.struct((-F.col(f"p{i}")).alias("neg"), F.lit(i).alias("cls")) for i in range(3)]))[0]["cls"]
    return g.withColumn("leading", lead)


def t_log_ratio(df: DataFrame, planes: Mapping[bool, Sequence[float]], sigmas: Mapping[bool, float], value: str, x1: str, x2: str) -> Column:
    """Log ratio of two Student-t(4) densities around class-specific planes; a missing value contributes 0."""
    def z(c):
        b = planes[c]
        return (F.col(value) - (b[0] + b[1] * F.col(x1) + b[2] * F.col(x2))) / sigmas[c]

    llr = -math.log(sigmas[True] / sigmas[False]) - 2.5 * (F.log(1.0 + z(True) * z(True) / 4.0) - F.log(1.0 + z(False) * z(False) / 4.0))
    return F.coalesce(llr, F.lit(0.0))

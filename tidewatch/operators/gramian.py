"""Logistic fits on whole vectors for many folds at once, from sums that each partition gives as one array.

A partition turns its rows into a matrix and adds up gradients for all fits, and Gramian matrices as packed upper triangles; arrays of equal key are then added in a
tree. Fits that differ only in the folds they leave out share one Hessian by fold and class, taken at the fit of all rows: a fold's part is subtracted from the
total, so one fold per source costs one pass with d ** 2 work per row, and the steps after it sum gradients alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import expit
from tidewatch.operators.models import Task
from tidewatch.session import cut, spread

#: Partitions whose arrays are added in one task; numbers in the arrays of one job; steps with one Hessian before it is taken anew.
FAN_IN, NUMBERS_AT_ONCE, STEPS = 64, 250_000, 12
#: Features from which fits that share a setting also share their Hessian.
SHARED_FROM = 8

SUMS = "key int, sums array<double>"


def array_sums(parts: DataFrame, keyed: bool = True) -> dict[int, np.ndarray]:
    """Sums of arrays by key. parts: key, sums (of one length for each key), a row or fewer for each key and partition.

    More than FAN_IN partitions are first added FAN_IN at a time in tasks. keyed: the rest is added in tasks too, one for each key; otherwise, where there is but one key
    and an array has NUMBERS_AT_ONCE numbers at most, on the driver.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for x in table.column("sums"))
        return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})

    n = parts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("_part", F.spark_partition_id() % n).groupBy("key", "_part").applyInArrow(add, SUMS)
    out: dict[int, np.ndarray] = {}
    for r in (parts.select("key", "sums").groupBy("key").applyInArrow(add, SUMS) if keyed else parts).collect():
        v = np.array(r["sums"])
        out[r["key"]] = out[r["key"]] + v if r["key"] in out else v
    return out


def matrix_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
    return batch.column("_f").to_numpy(), batch.column("_y").to_numpy(), batch.column("_w").to_numpy(), x.reshape(batch.num_rows, -1) if batch.num_rows else x.reshape(0, 0)


def emitted(sums: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["key", "sums"])


def packed(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def unpacked(v: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = v
    return m + np.triu(m, 1).T


def centres(base: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix_rows(batch)[3]
            if len(x):
                part = np.append(len(x), x.sum(0))
                total = part if total is None else total + part
        if total is not None:
            yield emitted({0: total})

    got = array_sums(base.mapInArrow(run, SUMS), keyed=False)[0]
    return got[1:] / got[0]


def moments(base: DataFrame, centre: np.ndarray) -> dict[int, np.ndarray]:
    """By fold: rows, weight of either class, sums and sums of squares of the centred features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            f, y, w, x = matrix_rows(batch)
            for k in np.unique(f).tolist():
                at = f == k
                z = x[at] - centre
                part = np.concatenate(([at.sum(), w[at & (y == 0)].sum(), w[at & (y == 1)].sum()], z.sum(0), (z * z).sum(0)))
                out[k] = out[k] + part if k in out else part
        if out:
            yield emitted(out)

    return array_sums(base.mapInArrow(run, SUMS))


class Fitting:
    """One fit's state: parameters in the coordinates that all fits share, its penalty and class weights there, and the Hessian's inverse in use."""

    def __init__(self, task: Task, by_fold: Mapping[int, np.ndarray], scale: np.ndarray):
        d = len(scale)
        total = sum((v for k, v in by_fold.items() if k not in task.without), np.zeros(3 + 2 * d))
        n = total[0]
        sd = np.sqrt(np.maximum(total[3 + d :] / max(n, 1) - (total[3 : 3 + d] / max(n, 1)) ** 2, 0.0))
        used = np.array([task.use is None or i in task.use for i in range(d)]) & (sd > 1e-12 * scale)
        self.task, self.used = task, np.append(0, 1 + np.flatnonzero(used))
        # features are standardised by the fit's own rows: its penalty is on the coefficient times its deviation
        self.penalty = np.append(0.0, ((sd / scale) ** 2)[used])
        self.classes = np.array([n / (2.0 * w) if w else 0.0 for w in total[1:3]])
        self.beta, self.inverse, self.done = np.zeros(d + 1), None, False
        self.last: tuple[np.ndarray, np.ndarray] | None = None  # gradient and move of the step before

    def hessian(self, h: np.ndarray) -> None:
        self.inverse = np.linalg.inv(self.task.c * h + np.diag(self.penalty) + 1e-12 * np.eye(len(h)))
        self.last = None

    def bend(self, g: np.ndarray) -> None:
        """A Hessian that is kept learns from the last step (the update of Broyden, Fletcher, Goldfarb and Shanno)."""
        before, move = self.last
        change = before - g
        curve = float(change @ move)
        if curve > 0:
            left = np.eye(len(g)) - np.outer(move, change) / curve
            self.inverse = left @ self.inverse @ left.T + np.outer(move, move) / curve

    def step(self, gradient: np.ndarray, tol: float) -> None:
        g = self.task.c * gradient[self.used] - self.penalty * self.beta[self.used]
        if self.last is not None:
            self.bend(g)
        move = self.inverse @ g
        self.last = (g, move)
        self.beta[self.used] += move
        self.done = bool(np.max(np.abs(move)) < tol)


def sums_now(base: DataFrame, centre: np.ndarray, scale: np.ndarray, live: Sequence[Fitting], exact: Sequence[bool]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each fit the gradient sum and, where exact, the Hessian sum over its own features, at its parameters."""
    beta, classes, without, used = np.array([s.beta for s in live]), np.array([s.classes for s in live]), [s.task.without for s in live], [s.used for s in live]
    wanted = np.flatnonzero(exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, hessians = np.zeros_like(beta), {int(t): np.zeros((len(used[t]), len(used[t]))) for t in wanted}
        for batch in batches:
            f, y, w, x = matrix_rows(batch)
            if not len(x):
                continue
            z = np.column_stack((np.ones(len(x)), (x - centre) / scale))
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta.T, -700, 700)))
            weight = w[:, None] * np.where(y[:, None] == 1.0, classes[:, 1], classes[:, 0])
            for t, out in enumerate(without):
                if out:
                    weight[np.isin(f, out), t] = 0.0
            gradient += (weight * (y[:, None] - p)).T @ z
            for t, h in hessians.items():
                own = z[:, used[t]]
                h += (own * (weight[:, t] * p[:, t] * (1.0 - p[:, t]))[:, None]).T @ own
        yield emitted({0: np.concatenate([gradient.ravel(), *[packed(h) for h in hessians.values()]])})

    got, at = array_sums(base.mapInArrow(run, SUMS), keyed=False)[0], beta.size
    gradient = got[:at].reshape(beta.shape)
    for t in range(len(live)):
        size = len(used[t]) * (len(used[t]) + 1) // 2 if exact[t] else 0
        yield gradient[t], unpacked(got[at : at + size], len(used[t])) if exact[t] else None
        at += size


def hessians_by_fold(base: DataFrame, centre: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(fold, class) to the Hessian sum of its rows at beta, without class weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            f, y, w, x = matrix_rows(batch)
            if not len(x):
                continue
            z = np.column_stack((np.ones(len(x)), (x - centre) / scale))
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -700, 700)))
            key, h = 2 * f + y.astype(f.dtype), w * p * (1.0 - p)
            for k in np.unique(key).tolist():
                at = key == k
                part = packed((z[at] * h[at, None]).T @ z[at])
                out[k] = out[k] + part if k in out else part
        if out:
            yield emitted(out)

    return {(k // 2, k % 2): unpacked(v, len(beta)) for k, v in array_sums(base.mapInArrow(run, SUMS)).items()}


def advance(base: DataFrame, centre: np.ndarray, scale: np.ndarray, fits: Sequence[Fitting], tol: float, max_iter: int) -> None:
    """Newton steps for all fits until none moves by tol. A fit that has a Hessian keeps it for STEPS steps."""
    for at in range(max_iter):
        live = [s for s in fits if not s.done]
        if not live:
            return
        exact = [s.inverse is None or len(s.used) <= SHARED_FROM or at % STEPS == STEPS - 1 for s in live]
        sizes = np.cumsum([len(s.beta) + e * len(s.used) ** 2 for s, e in zip(live, exact)])
        cuts = [0, *[i for i in range(1, len(live)) if sizes[i] // NUMBERS_AT_ONCE != sizes[i - 1] // NUMBERS_AT_ONCE], len(live)]
        for a, z in zip(cuts, cuts[1:]):
            for s, (g, h) in zip(live[a:z], sums_now(base, centre, scale, live[a:z], exact[a:z])):
                if h is not None:
                    s.hessian(h)
                s.step(g, tol)
    late = [s.task.name for s in fits if not s.done]
    if late:
        raise RuntimeError(f"{len(late)} fits have not converged in {max_iter} steps, such as {late[0]}")


def usable(df: DataFrame, fold: str, x: str, weight: str | None) -> DataFrame:
    """_f, _y, _w, _x of the rows whose vector is all finite numbers."""
    ok = F.col("_x").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.select(F.col(fold).cast("int").alias("_f"), F.col("positive").cast("int").cast("double").alias("_y"), w.alias("_w"), F.col(x).cast("array<double>").alias("_x")).where(ok)


def fit_vectors(df: DataFrame, fold: str, x: str, tasks: Sequence[Task], weight: str | None = None, tol: float = 1e-10, max_iter: int = 60) -> dict[str, dict]:
    """name to {"without", "intercept", "slopes" (for x as it is)} of standardised logistic regressions with an L2 penalty and class-balanced weights.

    df: fold (int), positive, x (array of numbers). Objective as in models.fit_logits: |w|^2 / 2 + C sum(weight x log loss), intercept free, features standardised by the
    rows the fit learns from. Rows whose x is null, holds null or non-finite numbers or has another length than most are not learnt from; without rows there is no fit. A
    feature that does not vary in a fit's rows has slope 0.
    """
    base = usable(df, fold, x, weight)
    length = base.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return {}
    base = cut(spread(base.where(F.size("_x") == length["d"])))
    centre = centres(base)
    by_fold = moments(base, centre)
    d = len(centre)
    whole = sum(by_fold.values())
    scale = np.sqrt(np.maximum(whole[3 + d :] / whole[0] - (whole[3 : 3 + d] / whole[0]) ** 2, 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    fits = {t.name: Fitting(t, by_fold, scale) for t in tasks}
    families: dict[tuple, list[Fitting]] = {}
    for s in fits.values():
        families.setdefault((s.task.c, s.task.use), []).append(s)
    for (c, use), family in families.items():
        if len(family) > 2 and (d if use is None else len(use)) > SHARED_FROM:
            middle = Fitting(Task("middle", (), c, use), by_fold, scale)
            advance(base, centre, scale, [middle], 1e-6, max_iter)
            parts = hessians_by_fold(base, centre, scale, middle.beta)
            total = [sum((h for (_, y), h in parts.items() if y == cls), np.zeros((d + 1, d + 1))) for cls in (0, 1)]
            for s in family:
                own = np.ix_(s.used, s.used)
                s.beta[s.used] = middle.beta[s.used]
                s.hessian(sum(s.classes[y] * (total[y] - sum((parts[(f, y)] for f in s.task.without if (f, y) in parts), np.zeros((d + 1, d + 1))))[own] for y in (0, 1)))
    advance(base, centre, scale, list(fits.values()), tol, max_iter)
    return {k: dict(without=s.task.without, slopes=s.beta[1:] / scale, intercept=float(s.beta[0] - (s.beta[1:] / scale) @ centre)) for k, s in fits.items()}


def predictor(x: str, slopes: Column, intercept: Column) -> Column:
    """Intercept plus the inner product of an array column and the slopes."""
    return intercept + F.aggregate(F.zip_with(F.col(x).cast("array<double>"), slopes, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def parameters(df: DataFrame, fits: Mapping[str, Mapping]) -> DataFrame:
    """model, intercept, slopes: the fits as a table, to be stored and joined."""
    return df.sparkSession.createDataFrame([(k, v["intercept"], v["slopes"].tolist()) for k, v in fits.items()], "model string, intercept double, slopes array<double>")


def scored(df: DataFrame, params: DataFrame, model: Column, x: str) -> DataFrame:
    """The rows with score, by the parameters of the model that `model` names (null where there is none)."""
    j = df.withColumn("_model", model).join(params.withColumnRenamed("model", "_model"), "_model", "left")
    return j.withColumn("score", expit(predictor(x, F.col("slopes"), F.col("intercept")))).drop("_model", "slopes", "intercept")


def held_out(df: DataFrame, fold: str, x: str, c: float = 1.0, weight: str | None = None, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, parameters by fold), one fit for each fold there is. extra: rows that only the training sides get."""
    train = df if extra is None else df.unionByName(extra.withColumn(fold, F.lit(-1).cast(df.schema[fold].dataType)), allowMissingColumns=True)
    folds = sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())
    params = parameters(df, fit_vectors(train, fold, x, [Task(str(k), (k,), c) for k in folds], weight))
    return scored(df, params, F.col(fold).cast("string"), x), params


def stationarity(train: DataFrame, params: DataFrame, fold: str, x: str, c: float = 1.0, weight: str | None = None) -> DataFrame:
    """model (a fold), n_train, gradient: the largest partial derivative of the fold's objective at its parameters, by absolute value; 0 at the optimum.

    A check of held_out() that takes nothing from the fit but its parameters: one pass over the rows sums residuals times features for every (fold left out, class), and
    moments by fold for the class weights and deviations. n_train counts every row outside the fold, also those that fit_vectors() does not learn from.
    """
    models = sorted(((int(r["model"]), r["intercept"], r["slopes"]) for r in params.collect()), key=lambda m: m[0])
    n_all = {r["_f"]: r["n"] for r in train.groupBy(F.col(fold).cast("int").alias("_f")).agg(F.count(F.lit(1)).alias("n")).where("_f is not null").collect()}
    out = []
    if models:
        d = len(models[0][2])
        base = cut(spread(usable(train, fold, x, weight).where((F.size("_x") == d) & F.col("_f").isNotNull())))
        centre = centres(base)
        by_fold = moments(base, centre)
        whole, none = sum(by_fold.values()), np.zeros(3 + 2 * d)
        step = max(1, NUMBERS_AT_ONCE // (2 * (d + 1)))
        for a in range(0, len(models), step):
            some = models[a : a + step]
            for (name, _, slopes), g in zip(some, residual_sums(base, centre, some)):
                n, w0, w1, *rest = whole - by_fold.get(name, none)
                mean, square = np.array(rest[:d]) / n, np.array(rest[d:]) / n
                sd = np.sqrt(np.maximum(square - mean**2, 0.0))
                total = sum(g[y] * (n / (2.0 * w) if w else 0.0) for y, w in ((0, w0), (1, w1)))
                # in the fold's own standardised coordinates
                varies = sd > 1e-12 * np.maximum(1e-300, np.sqrt(whole[3 + d :] / whole[0]))
                standard = np.where(varies, (total[1:] - mean * total[0]) / np.where(varies, sd, 1.0), 0.0)
                gradient = np.append(c * total[0], c * standard - np.array(slopes) * sd)
                out.append((str(name), int(sum(n_all.values()) - n_all.get(name, 0)), float(np.max(np.abs(gradient)))))
    return train.sparkSession.createDataFrame(out, "model string, n_train long, gradient double")


def residual_sums(base: DataFrame, centre: np.ndarray, models: Sequence[tuple[int, float, Sequence[float]]]) -> np.ndarray:
    """(model, class, 1 + feature): sums of weight x (class - probability) x centred feature over the rows outside the model's fold."""
    names, slopes = np.array([m[0] for m in models]), np.array([m[2] for m in models])
    intercepts = np.array([m[1] for m in models]) + slopes @ centre
    shape = (len(models), 2, len(centre) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            f, y, w, x = matrix_rows(batch)
            if not len(x):
                continue
            z = np.column_stack((np.ones(len(x)), x - centre))
            p = 1.0 / (1.0 + np.exp(-np.clip(z[:, 1:] @ slopes.T + intercepts, -700, 700)))
            r = np.where(f[:, None] == names, 0.0, w[:, None] * (y[:, None] - p))
            for k in (0, 1):
                total[:, k] += r[y == k].T @ z[y == k]
        yield emitted({0: total.ravel()})

    return array_sums(base.mapInArrow(run, SUMS), keyed=False)[0].reshape(shape)

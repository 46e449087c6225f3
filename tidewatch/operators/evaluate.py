"""Scores to metrics: source tables, weighted rank AUC, balanced accuracy, conformal sets, checks and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import attach_row, scan, spearman


def source_table(oof: DataFrame, keys: Sequence[str], score: str = "score", cut: float = 0.5, digits: int | None = None) -> DataFrame:
    """One row per (keys, source): class, rows, correct rows, mean score, thresholded class and whether it is right."""
    right = ((F.col(score) >= cut) == F.col("positive")).cast("long")
    g = oof.groupBy(*keys, "source_id").agg(F.max("positive").alias("positive"), F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_correct"), F.avg(score).alias("score"))
    if digits is not None:
        g = g.withColumn("score", F.round("score", digits))
    return g.withColumn("predicted", F.col("score") >= cut).withColumn("correct", (F.col("predicted") == F.col("positive")).cast("int"))


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column) -> DataFrame:
    """Counts, recall per class and balanced accuracy."""
    p = F.col("positive")

    def n(c):
        return F.sum(F.when(c, 1).otherwise(0))

    g = df.groupBy(*keys).agg(n(p & predicted).alias("tp"), n(p & ~predicted).alias("fn"), n(~p & predicted).alias("fp"), n(~p & ~predicted).alias("tn"))
    g = g.withColumns({"sensitivity": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))})
    return g.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2.0)


def _by_score(df: DataFrame, keys, score: str, weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys, F.col(score).alias("_v")).agg(F.sum(F.when(F.col("positive"), w).otherwise(0.0)).alias("wp"),
                                                            F.sum(F.when(F.col("positive"), 0.0).otherwise(w)).alias("wn"))


def auc(df: DataFrame, keys: Sequence[str], score: str = "score", weight: Column | None = None, n_cells: int | None = None, out: str = "auc") -> DataFrame:
    """Weighted rank AUC with half credit for ties per key; NULL when a class is absent.

    Rows are reduced to distinct scores first. n_cells=0 states that a key has few distinct scores (e.g. one per source).
    """
    s = scan(_by_score(df, keys, score, weight), keys, "_v", running={"_below": ("sum", F.col("wn"), False)}, n_cells=n_cells)
    u = F.sum(F.col("wp") * (F.col("_below") + 0.5 * F.col("wn")))
    return s.groupBy(*keys).agg(F.try_divide(u, F.sum("wp") * F.sum("wn")).alias(out))


def weighted_accuracy(df: DataFrame, keys: Sequence[str], score: str, weight: Column, cut: float = 0.5) -> DataFrame:
    """Balanced accuracy at a cut with weights."""
    p, hit = F.col("positive"), (F.col(score) >= cut) == F.col("positive")
    g = df.groupBy(*keys).agg(*[F.sum(F.when(c, weight)).alias(n) for n, c in (("_p", p), ("_n", ~p), ("_tp", p & hit), ("_tn", ~p & hit))])
    z = F.lit(0.0)
    ba = (F.try_divide(F.coalesce("_tp", z), F.col("_p")) + F.try_divide(F.coalesce("_tn", z), F.col("_n"))) / 2.0
    return g.select(*keys, ba.alias("balanced_accuracy"))


def point_metrics(oof: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """Source balanced accuracy, source AUC, observation balanced accuracy and the 'k/n correct' text."""
    t = source_table(oof, keys, digits=digits)
    src = confusion(t, keys, F.col("predicted")).select(*keys, F.col("balanced_accuracy").alias("source_ba"), (F.col("tp") + F.col("tn")).alias("_k"),
                                                        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("_n"))
    p = F.col("positive")
    obs = t.groupBy(*keys).agg(((F.try_divide(F.sum(F.when(p, F.col("n_correct"))), F.sum(F.when(p, F.col("n"))))
                                + F.try_divide(F.sum(F.when(~p, F.col("n_correct"))), F.sum(F.when(~p, F.col("n"))))) / 2.0).alias("obs_ba"))
    j = src.join(auc(t, keys, out="source_auc"), list(keys)).join(obs, list(keys))
    return j.withColumn("correct", F.concat(F.col("_k").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(" correct"))).drop("_k", "_n")


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str, cut: float = 0.5) -> DataFrame:
    """Rank correlation and share of equal labels of two score sets over their common rows."""
    j = a.select(*keys, F.col(score).alias("_a")).join(b.select(*keys, F.col(score).alias("_b")), list(keys))
    return paired_agreement(j, "_a", "_b", cut)


def paired_agreement(df: DataFrame, first: str, second: str, cut: float = 0.5) -> DataFrame:
    """The same for two scores that stand in one row: nothing is joined, and rows are reduced to distinct pairs before they move."""
    j = df.select(F.col(first).alias("_a"), F.col(second).alias("_b"), F.lit(0).alias("_g"))
    same = j.groupBy("_g").agg(F.avg(((F.col("_a") >= cut) == (F.col("_b") >= cut)).cast("double")).alias("label_agreement"))
    return spearman(j, ["_g"], "_a", "_b").join(same, "_g").drop("_g")


def influence(df: DataFrame, keys: Sequence[str], score: str, n_cells: int | None = None) -> DataFrame:
    """AUC without each positive source in turn.

    The statistic is a sum over positive rows, so one pass gives every left-out value: (U - U_s) / ((P - P_s) N).
    """
    base = df.groupBy(*keys, F.col(score).alias("_v"), "source_id", "positive").agg(F.count(F.lit(1)).cast("double").alias("c"))
    by = base.groupBy(*keys, "_v").agg(F.sum(F.when(F.col("positive"), 0.0).otherwise(F.col("c"))).alias("wn"))
    below = scan(by, keys, "_v", running={"_below": ("sum", F.col("wn"), False)}, totals={"_N": ("sum", F.col("wn"))}, n_cells=n_cells)
    u = base.where("positive").join(below, [*keys, "_v"]).groupBy(*keys, "source_id").agg(
        F.sum(F.col("c") * (F.col("_below") + 0.5 * F.col("wn"))).alias("_u"), F.sum("c").alias("_p"), F.max("_N").alias("_neg"))
    tot = u.groupBy(*keys).agg(F.sum("_u").alias("_u_all"), F.sum("_p").alias("_p_all"))
    j = u.join(tot, list(keys)) if keys else attach_row(u, tot)
    left = F.try_divide(F.col("_u_all") - F.col("_u"), (F.col("_p_all") - F.col("_p")) * F.col("_neg"))
    return j.select(*keys, F.col("source_id").alias("left_out"), left.alias("auc"), F.try_divide(F.col("_u_all"), F.col("_p_all") * F.col("_neg")).alias("auc_all"))


def mean_influence(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Difference of the class means of source values without each source in turn: (keys, left_out, positive, difference, difference_all).

    df: one row per source with positive; null values take no part. Sums and counts by class give every left-out mean. A class that is then empty gives null.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, "source_id", "positive", F.col(value).cast("double").alias("_v"))
    p = F.col("positive")
    tot = d.groupBy(*keys).agg(F.sum(F.when(p, F.col("_v"))).alias("_s1"), F.sum(F.when(~p, F.col("_v"))).alias("_s0"), F.count(F.when(p, 1)).alias("_n1"), F.count(F.when(~p, 1)).alias("_n0"))
    j = d.join(tot, list(keys)) if keys else attach_row(d, tot)

    def mean(own, s, n):
        return F.when(own, F.try_divide(F.col(s) - F.col("_v"), F.col(n) - 1)).otherwise(F.try_divide(F.col(s), F.col(n)))

    left = mean(p, "_s1", "_n1") - mean(~p, "_s0", "_n0")
    every = F.try_divide(F.col("_s1"), F.col("_n1")) - F.try_divide(F.col("_s0"), F.col("_n0"))
    return j.select(*keys, F.col("source_id").alias("left_out"), "positive", left.alias("difference"), every.alias("difference_all"))


def conformal(calibration: DataFrame, test: DataFrame, eps: float, leave_out: bool = False) -> DataFrame:
    """Class-conditional conformal p-values and sets from (source_id, positive, score) and (source_id, score).

    Both counts are running counts over the score order, so calibration and test rows are never paired. With leave_out, test and calibration
    are the same sources and each is judged by the others.
    """
    c = calibration.select(F.col("score").alias("_v"), "positive", F.lit(1).alias("_c"))
    t = test.select(F.col("score").alias("_v"), F.lit(None).cast("boolean").alias("positive"), F.lit(0).alias("_c"))
    by = c.unionByName(t).groupBy("_v").agg(F.sum(F.when(F.col("positive"), 1).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), 1).otherwise(0)).alias("n"))
    s = scan(by, [], "_v", running={"_p_le": ("sum", F.col("p"), True), "_n_lt": ("sum", F.col("n"), False)}, totals={"_P": ("sum", F.col("p")), "_N": ("sum", F.col("n"))})
    j = test.join(s.withColumnRenamed("_v", "score"), "score")
    own_p = F.col("positive").cast("int") if leave_out else F.lit(0)
    own_n = (~F.col("positive")).cast("int") if leave_out else F.lit(0)
    p1 = (1 + F.col("_p_le") - own_p) / (1 + F.col("_P") - own_p)
    p0 = (1 + F.col("_N") - F.col("_n_lt") - own_n) / (1 + F.col("_N") - own_n)
    both = F.when(p1 > eps, F.when(p0 > eps, "{pos,neg}").otherwise("{pos}")).otherwise(F.when(p0 > eps, "{neg}").otherwise("{}"))
    return j.select(*test.columns, p1.alias("p_pos"), p0.alias("p_neg"), both.alias("set"))


def conformal_summary(sets: DataFrame) -> DataFrame:
    """Coverage per class, mean set size, share of right singletons and number of ambiguous sources."""
    p = F.col("positive")
    covered = F.when(p, F.contains(F.col("set"), F.lit("pos"))).otherwise(F.contains(F.col("set"), F.lit("neg"))).cast("double")
    size = F.contains(F.col("set"), F.lit("pos")).cast("int") + F.contains(F.col("set"), F.lit("neg")).cast("int")
    return sets.agg(F.avg(F.when(p, covered)).alias("coverage_pos"), F.avg(F.when(~p, covered)).alias("coverage_neg"), F.avg(size).alias("mean_size"),
                    F.avg(F.when(size == 1, covered)).alias("singleton_correct"), F.count(F.when(size == 2, 1)).alias("n_ambiguous"))


def drift(oof: DataFrame, epoch: str, score: str) -> DataFrame:
    """Score by epoch within class: rows, mean, and the rank correlation with the epoch."""
    g = oof.groupBy("positive", epoch).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    return g.join(spearman(oof, ["positive"], epoch, score).select("positive", "rho"), "positive")


def gate(values: DataFrame, rules: Mapping[str, tuple[str, float]], stop: bool = False) -> DataFrame:
    """One row per named value of a one-row frame: value, threshold, passed. op is '>=' or '<='. stop raises on a failure."""
    items = []
    for name, (op, limit) in rules.items():
        v = F.col(name).cast("double")
        ok = F.coalesce(v >= limit if op == ">=" else v <= limit, F.lit(False))
        items.append(F.struct(F.lit(name).alias("check"), v.alias("value"), F.lit(float(limit)).alias("threshold"), ok.alias("passed")))
    d = values.select(F.explode(F.array(*items)).alias("c")).select("c.*")
    if stop:
        d = d.withColumn("passed", F.when(F.col("passed"), True).otherwise(F.raise_error(F.concat(F.lit("gate failed: "), F.col("check")))))
    return d


def same_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float) -> DataFrame:
    """Whether stored and new interval triplets agree."""
    cols = ["point", "low", "high"]
    r = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    j = a.join(r, list(keys), "full_outer")
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in cols])
    return j.select(*keys, gap.alias("max_gap"), F.coalesce(gap <= atol, F.lit(False)).alias("reproduced"))


def audit_claims(claims: DataFrame, metrics: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every claim must select exactly one metric row, and its value must agree after rounding to the claimed decimals.

    claims: claim_id, keys (the filters), claimed, digits, tol.
    """
    m = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
    j = claims.join(m, list(keys), "left")
    scale = F.pow(F.lit(10.0), F.col("digits").cast("double"))
    rounded = F.round(F.col("_v") * scale) / scale
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return j.select("claim_id", n.alias("n_rows"), rounded.alias("found"),
                    F.coalesce((n == 1) & (F.abs(rounded - F.col("claimed")) <= F.col("tol")), F.lit(False)).alias("supported"))


def testable(df: DataFrame, keys: Sequence[str], min_sources: int = 3) -> DataFrame:
    """Whether a stratum has enough sources of both classes to be primary."""
    s = df.groupBy(*keys, "source_id").agg(F.max("positive").alias("positive"))
    p = F.col("positive")
    g = s.groupBy(*keys).agg(F.count(F.when(p, 1)).alias("n_pos"), F.count(F.when(~p, 1)).alias("n_neg"))
    return g.withColumn("role", F.when((F.col("n_pos") >= min_sources) & (F.col("n_neg") >= min_sources), "primary").otherwise("descriptive"))


"""Grouped summaries. Every operator here reduces with map-side aggregation before any shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import col, ratio, signed_sqrt
from tidewatch.operators.ordered import percentiles


def attrition(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Survivors per key after each rule and all rules before it; a missing value fails."""
    ok, aggs = None, []
    for name, r in rules.items():
        r = F.coalesce(r, F.lit(False))
        ok = r if ok is None else ok & r
        aggs.append(F.sum(F.when(ok, 1).otherwise(0)).alias(name))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"), *aggs)


def group_summary(df: DataFrame, keys: Sequence[str], value: str, constant: str, distinct: str) -> DataFrame:
    """Count, mean, median, a constant of the group and a distinct count."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(constant).alias(constant))
    d = df.groupBy(*keys, distinct).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(distinct).alias("n_distinct"))
    return g.join(percentiles(df, keys, value, {"median": 0.5}), list(keys), "left").join(d, list(keys))


def value_shares(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and shares of the values of a column per key."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return c.join(total, list(keys)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """2 x 2 table of two flags and the share of rows on which they agree."""
    n = {f"n{int(x)}{int(y)}": F.sum(F.when((a == F.lit(x)) & (b == F.lit(y)), 1).otherwise(0)) for x in (True, False) for y in (True, False)}
    g = df.agg(*[c.alias(k) for k, c in n.items()])
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return g.withColumn("agreement", F.try_divide(F.col("n11") + F.col("n00"), total))


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence) -> DataFrame:
    return df.groupBy(rows).pivot(cols, list(values)).count().na.fill(0)


def empty_bins(candidates: DataFrame, filled: DataFrame, group: str, bin_col: str) -> DataFrame:
    """Bins of a group that have candidates, that were filled, and that stayed empty."""
    c = candidates.select(group, bin_col).distinct()
    f = filled.select(group, bin_col).distinct().withColumn("_f", F.lit(1))
    g = c.join(f, [group, bin_col], "left").groupBy(group).agg(F.count(F.lit(1)).alias("n_bins"), F.count("_f").alias("n_filled"))
    return g.withColumn("n_empty", F.col("n_bins") - F.col("n_filled"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                              F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.join(percentiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), list(keys))


def wide(df: DataFrame, rows: Sequence[str], cols: str, values: Sequence, measures: Mapping[str, str]) -> DataFrame:
    """Long to wide with the listed column values; one output column per (value, measure)."""
    aggs = [F.first(F.when(F.col(cols) == v, F.col(m)), ignorenulls=True).alias(f"{short}_{v}") for v in values for m, short in measures.items()]
    return df.groupBy(*rows).agg(*aggs)


def split_half(df: DataFrame, keys: Sequence[str], value: str, parity: Column) -> DataFrame:
    """Mean of the odd and of the even rows of every key."""
    return df.groupBy(*keys).agg(F.avg(F.when(parity % 2 == 1, F.col(value))).alias("odd"), F.avg(F.when(parity % 2 == 0, F.col(value))).alias("even"))


def half_difference(halves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median of |odd - even| / 2 over the groups that have both halves."""
    d = halves.where("odd is not null and even is not null").withColumn("_d", F.abs(F.col("odd") - F.col("even")) / 2.0)
    return percentiles(d, keys, "_d", {"half_difference": 0.5})


def standardise(df: DataFrame, keys: Sequence[str], values: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Columns centred and scaled by the population deviation of their group; a constant column only centred."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"))]
    if keys:
        j = df.join(df.groupBy(*keys).agg(*aggs), list(keys))
        stat = F.col
    else:
        row = df.agg(*aggs).first().asDict()
        j, stat = df, lambda c: F.lit(row[c])
    for v in values:
        s = stat(f"_s_{v}")
        j = j.withColumn(f"{v}{suffix}", (F.col(v) - stat(f"_m_{v}")) / F.when(s > 0, s).otherwise(1.0))
    return j.drop(*[f"_{k}_{v}" for v in values for k in "ms"])


def ratio_of_sums(df: DataFrame, keys: Sequence[str], num: str, den: str, name: str = "ratio") -> DataFrame:
    """Ratio of sums and its delta-method error, from sums only, so that partial aggregation stays possible."""
    x, d = F.col(num), F.col(den)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("_x"), F.sum(d).alias("_d"), F.sum(x * x).alias("_xx"),
                              F.sum(x * d).alias("_xd"), F.sum(d * d).alias("_dd"))
    r = ratio("_x", "_d")
    left = F.greatest(F.lit(0.0), F.col("_xx") - 2.0 * r * F.col("_xd") + r * r * F.col("_dd"))
    se = F.when(F.col("n") > 1, F.try_divide(F.sqrt(left * F.col("n") / (F.col("n") - 1)), F.abs("_d")))
    return g.withColumns({name: r, f"{name}_se": se}).drop("_x", "_d", "_xx", "_xd", "_dd")


def mean_of_ratios(df: DataFrame, keys: Sequence[str], num: str, den: str) -> DataFrame:
    q = ratio(num, den)
    return df.groupBy(*keys).agg(F.count(q).alias("n"), F.avg(q).alias("ratio"), (F.stddev_samp(q) / F.sqrt(F.count(q))).alias("ratio_se"))


def inverse_variance_mean(df: DataFrame, keys: Sequence[str], value: str, error: str, z_cut: float = 3.0) -> DataFrame:
    """Weighted mean, error, z, upper limit and detection call."""
    w = F.try_divide(F.lit(1.0), F.col(error) * F.col(error))
    g = df.groupBy(*keys).agg(F.count(w).alias("n"), F.sum(F.col(value) * w).alias("_xw"), F.sum(w).alias("_w"))
    g = g.withColumns({"mean": ratio("_xw", "_w"), "se": F.try_divide(F.lit(1.0), F.sqrt("_w"))})
    g = g.withColumns({"z": ratio("mean", "se"), "upper_limit": F.greatest(F.col("mean"), F.lit(0.0)) + z_cut * F.col("se")})
    return g.withColumn("detected", F.col("z") > z_cut).drop("_xw", "_w")


def minus_null_band(df: DataFrame, value: str, error: str, null: str, null_error: str, width: float, null_width: float) -> DataFrame:
    """Subtract a reference band scaled by the band widths, with the error of the difference."""
    k = width / null_width
    return df.withColumns({f"{value}_net": F.col(value) - k * F.col(null),
                           f"{value}_net_se": F.sqrt(F.pow(F.col(error), 2.0) + k * k * F.pow(F.col(null_error), 2.0))})


def main_mode(df: DataFrame, key: str, mode: str, size: str) -> DataFrame:
    """The mode with the largest total size per key; ties go to the smaller name."""
    g = df.groupBy(key, mode).agg(F.sum(size).alias("total"))
    return g.groupBy(key).agg(F.min_by(F.struct(mode, "total"), F.struct((-F.col("total")).alias("a"), F.col(mode).alias("b"))).alias("_m")).select(key, "_m.*")


def weighted_plane(df: DataFrame, keys: Sequence[str], y: str, x1: str, x2: str, w: str, ridge: float = 1e-9, floor: float = 0.0) -> DataFrame:
    """Weighted least squares of y on (1, x1, x2) per key: normal equations by sums, solved in closed form."""
    W, Y, A, B = (F.col(c) for c in (w, y, x1, x2))
    sums = {"s0": W, "sa": W * A, "sb": W * B, "saa": W * A * A, "sab": W * A * B, "sbb": W * B * B, "sy": W * Y, "say": W * A * Y, "sby": W * B * Y, "syy": W * Y * Y}
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    s = {k: F.col(k) for k in sums}
    m = [[s["s0"] + ridge, s["sa"], s["sb"]], [s["sa"], s["saa"] + ridge, s["sab"]], [s["sb"], s["sab"], s["sbb"] + ridge]]
    r = [s["sy"], s["say"], s["sby"]]

    def det(a):
        return (a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
                + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0]))

    g = g.withColumn("_det", det(m))
    for i in range(3):
        swapped = [[r[k] if j == i else m[k][j] for j in range(3)] for k in range(3)]
        g = g.withColumn(f"beta{i}", F.try_divide(det(swapped), F.col("_det")))
    b = [F.col(f"beta{i}") for i in range(3)]
    rss = (s["syy"] - 2 * (b[0] * r[0] + b[1] * r[1] + b[2] * r[2]) + b[0] * b[0] * s["s0"] + b[1] * b[1] * s["saa"] + b[2] * b[2] * s["sbb"]
           + 2 * (b[0] * b[1] * s["sa"] + b[0] * b[2] * s["sb"] + b[1] * b[2] * s["sab"]))
    sigma = F.greatest(F.lit(float(floor)), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(rss, s["s0"]))))
    return g.withColumn("sigma", sigma).select(*keys, "n", "beta0", "beta1", "beta2", "sigma")


def moments(df: DataFrame, keys: Sequence[str], x: str, y: str, sample: bool = True) -> DataFrame:
    """Mean vector and covariance of two columns per class."""
    cov = F.covar_samp if sample else F.covar_pop
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
                                 cov(x, x).alias("cxx"), cov(x, y).alias("cxy"), cov(y, y).alias("cyy"))


def check_report(checks: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One PASS/FAIL row per named check; each check is an aggregate over one frame."""
    out = None
    for name, (df, ok) in checks.items():
        d = df.agg(F.coalesce(ok, F.lit(False)).alias("_ok")).select(F.lit(name).alias("check"), F.when(F.col("_ok"), "PASS").otherwise("FAIL").alias("result"))
        out = d if out is None else out.unionByName(d)
    return out


def median_vector(df: DataFrame, arr: str) -> DataFrame:
    """Element-wise median over all rows of equally long vectors: (pos, median)."""
    return percentiles(df.select(F.posexplode(arr).alias("pos", "_x")), ["pos"], "_x", {"median": 0.5})


def relative_deviation(df: DataFrame, key: str, arr: str) -> DataFrame:
    """Mean absolute relative deviation of every row from the median vector (bounded by the vector length)."""
    med = {r["pos"]: r["median"] for r in median_vector(df, arr).collect()}
    ref = F.array(*[F.lit(med[i]) for i in sorted(med)])
    dev = F.zip_with(arr, ref, lambda a, b: F.abs(F.try_divide(a - b, b)))
    return df.select(key, F.try_divide(F.aggregate(dev, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.size(arr)).alias("deviation"))


def tilt(df: DataFrame, category: str, arr: str, low: int, high: int) -> DataFrame:
    """Median ratio of two vector elements by category."""
    d = df.select(category, F.try_divide(F.element_at(arr, high), F.element_at(arr, low)).alias("_q"))
    return percentiles(d, [category], "_q", {"tilt": 0.5})


def accuracy_range(per_source: DataFrame, keys: Sequence[str], acc: str) -> DataFrame:
    """Mean of the source accuracies and its range when one source is left out: sums and extremes suffice."""
    g = per_source.groupBy(*keys).agg(F.count(acc).alias("n_sources"), F.sum(acc).alias("_s"), F.min(acc).alias("_lo"), F.max(acc).alias("_hi"))
    n = F.col("n_sources")
    return g.select(*keys, "n_sources", (F.col("_s") / n).alias("mean_accuracy"), F.try_divide(F.col("_s") - F.col("_hi"), n - 1).alias("low"),
                    F.try_divide(F.col("_s") - F.col("_lo"), n - 1).alias("high"))


def tertile_cuts(df: DataFrame, value: str) -> tuple[float, float]:
    """The two cut points (two numbers come to the driver)."""
    r = percentiles(df, [], value, {"a": 1 / 3, "b": 2 / 3}).first()
    return r["a"], r["b"]


def tertile_label(value: str, cuts: tuple[float, float]) -> Column:
    c = F.col(value)
    return F.when(c.isNull(), None).when(c <= cuts[0], "low").when(c <= cuts[1], "mid").otherwise("high")


def band_rates(spectrum: DataFrame, keys: Sequence[str], channel: str, bands: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Rate per channel band; counts over exposure where no rate is given."""
    rate = F.coalesce(F.col("rate"), F.try_divide(F.col("counts"), F.col("exposure")))
    return spectrum.groupBy(*keys).agg(*[F.sum(F.when((F.col(channel) >= lo) & (F.col(channel) < hi), rate)).alias(b) for b, (lo, hi) in bands.items()])


def rms_from_variance(c) -> Column:
    return signed_sqrt(col(c))

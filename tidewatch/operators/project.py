"""Filters, gates and row-level features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import col, fixed_text, ratio, step_bin
from tidewatch.operators.ordered import percentiles

# Dates (MJD) of the leap seconds since 1994 and TAI-UTC in seconds from each date on.
LEAP_MJD = [49534, 50083, 50630, 51179, 53736, 54832, 56109, 57204, 57754]
LEAP_FIRST = 29
TT_MINUS_TAI = 32.184


def eligible(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Rows that meet every rule; a missing value fails."""
    for r in rules:
        df = df.where(r)
    return df


def at_least_or_missing(df: DataFrame, c: str, threshold: float) -> DataFrame:
    return df.where((F.col(c) >= threshold) | F.col(c).isNull())


def quality_gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Status and the ';'-joined list of all rules that failed; a missing value fails its rule."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("reason", F.array_join(failed, ";")).withColumn(
        "status", F.when(F.col("reason") == "", "accepted").otherwise("excluded"))


def band_weights(edges: Sequence[tuple[float, float]], lo: float, hi: float) -> list[float]:
    """Width of every bin whose geometric centre lies in [lo, hi), else 0."""
    return [b - a if lo <= math.sqrt(a * b) < hi else 0.0 for a, b in edges]


def band_sum(arr, edges, lo: float, hi: float) -> Column:
    """Sum of value x width over the bins of a band; runs inside the row, no shuffle."""
    w = F.array(*[F.lit(x) for x in band_weights(edges, lo, hi)])
    return F.aggregate(F.zip_with(col(arr), w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def colours(df: DataFrame, arr: str, edges, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Hardness ratios b2/b1 and b4/b3, the log total, and a flag that all denominators are positive."""
    b = [band_sum(arr, edges, lo, hi) for lo, hi in bands]
    d = df.withColumns({f"b{i + 1}": x for i, x in enumerate(b)})
    total = F.col("b1") + F.col("b2") + F.col("b3") + F.col("b4")
    return d.withColumns({"c1": ratio("b2", "b1"), "c2": ratio("b4", "b3"), "log_total": F.when(total > 0, F.log10(total)),
                          "positive_bands": (F.col("b1") > 0) & (F.col("b3") > 0)})


def response_normalised(df: DataFrame, observed: str, expected: str, edges, bands) -> DataFrame:
    """Vector and colours relative to what the response would give for a reference spectrum."""
    q = [F.try_divide(band_sum(observed, edges, lo, hi), band_sum(expected, edges, lo, hi)) for lo, hi in bands]
    d = df.withColumn("norm", F.zip_with(observed, expected, F.try_divide)).withColumns({f"q{i + 1}": x for i, x in enumerate(q)})
    return d.withColumns({"c1": ratio("q2", "q1"), "c2": ratio("q4", "q3")})


def relative_intensity(df: DataFrame, group: Sequence[str], total: str, p: float = 0.9999) -> DataFrame:
    """Value over the p-quantile of its group."""
    ref = percentiles(df, group, total, {"_ref": p})
    return df.join(ref, list(group)).withColumn("intensity", ratio(total, "_ref")).drop("_ref")


def epoch_key(source, t, digits: int = 1) -> Column:
    return F.concat_ws("_", col(source).cast("string"), fixed_text(t, digits))


def mode_qualifies(mode, pattern: str, chain, bits: str, step, max_step: float, columns, needed: str) -> Column:
    """File rule: mode text, bit pattern, time step and presence of a column."""
    return (col(mode).rlike(pattern) & col(chain).contains(bits) & (col(step) <= max_step + 1e-12) & F.array_contains(col(columns), needed))


def extract_all(df: DataFrame, text: str, pattern: str, out: str, group: int = 1) -> DataFrame:
    """One row per match of a pattern in the whole text."""
    return df.withColumn(out, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def size_bytes(text) -> Column:
    """Bytes of a size text such as 12K, 3.5M or 1G."""
    number = F.regexp_extract(col(text), r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(col(text), r"([KMG])$", 1)
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1048576.0).when(unit == "G", 1073741824.0).otherwise(1.0)
    return number * scale


def jname_position(name) -> tuple[Column, Column]:
    """Degrees of a name of the form JHHMM.m+DDMM."""
    pat = r"J(\d{2})(\d{2}\.\d)([+-])(\d{2})(\d{2})"
    g = [F.regexp_extract(col(name), pat, i) for i in range(1, 6)]
    ra = 15.0 * (g[0].cast("double") + g[1].cast("double") / 60.0)
    dec = F.when(g[2] == "-", -1.0).otherwise(1.0) * (g[3].cast("double") + g[4].cast("double") / 60.0)
    return ra, dec


def month_paths(df: DataFrame, day: str, shifts: Sequence[int] = (0, -31, 31)) -> DataFrame:
    """Year-month folder keys of a date and of its neighbours."""
    d = df.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    return d.withColumn("month_key", F.date_format(F.date_add(F.col(day), F.col("shift")), "yyyy_MM"))


def map_category(c, mapping: Mapping[str, str], default: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col(c) == k, v) if out is None else out.when(col(c) == k, v)
    return out.otherwise(F.lit(default))


def in_box(x, y, x_range, y_range) -> Column:
    return col(x).between(*x_range) & col(y).between(*y_range)


def dead_time(rates: DataFrame, keys: Sequence[str], detector: str, rate: str, other: str, large: str, selected: str,
              on_above: float = 1.0, per_event: float = 1e-5, per_large: float = 6e-5) -> DataFrame:
    """Dead-time fraction averaged over the selected detectors (digits of a text) and the live-time correction.

    rates is long (keys, detector, rate) with the array totals ``other`` and ``large`` repeated on each row.
    """
    on = (F.col(rate) > on_above).cast("int")
    chosen = F.contains(F.col(selected), F.col(detector).cast("string")).cast("int")
    g = rates.groupBy(*keys).agg(F.sum(on).alias("n_on"), F.sum(F.when(chosen == 1, F.col(rate))).alias("_xe"),
                                 F.sum(chosen).alias("_k"), F.first(other).alias("_o"), F.first(large).alias("_l"))
    share = F.try_divide(F.lit(per_event) * F.col("_o") + F.lit(per_large) * F.col("_l"), F.col("n_on"))
    d = g.withColumn("fraction", F.lit(per_event) * F.try_divide(F.col("_xe"), F.col("_k")) + share)
    return d.withColumn("correction", F.try_divide(F.lit(1.0), 1.0 - F.col("fraction"))).drop("_xe", "_k", "_o", "_l")


def net_spectrum(src: DataFrame, bkg: DataFrame, keys: Sequence[str], factor: str) -> DataFrame:
    """Net rate per channel and its error. Both sides: keys, counts, time, area; scale = area ratio."""
    b = bkg.select(*keys, F.col("counts").alias("_bc"), F.col("time").alias("_bt"), F.col("area").alias("_ba"))
    j = src.join(b, list(keys))
    k, scale = F.col(factor), F.try_divide(F.col("area"), F.col("_ba"))
    s_den, b_den = F.col("time") * F.col("area"), F.col("_bt") * F.col("area")
    net = k * (F.try_divide(F.col("counts"), s_den) - scale * F.try_divide(F.col("_bc"), b_den))
    err = k * F.sqrt(F.try_divide(F.col("counts"), s_den * s_den) + scale * scale * F.try_divide(F.col("_bc"), b_den * b_den))
    return j.withColumns({"net": net, "err": err}).drop("_bc", "_bt", "_ba")


def background_corrected(df: DataFrame, fractions: DataFrame, key: str, bands: Mapping[str, str], amplitudes: Sequence[str],
                         total_fraction: str, fmax: float, correct: bool = True) -> DataFrame:
    """Drop rows above the screen, remove the background share from bands and rescale amplitudes.

    A share that equals the screen stays, whatever the last bits that the order of its sum left.
    """
    j = df.join(fractions, key, "left")
    f = F.coalesce(F.col(total_fraction), F.lit(0.0))
    j = j.where(F.round(f, 12) <= fmax)
    if not correct:
        return j
    new = {b: F.col(b) * (1.0 - F.coalesce(F.col(fb), F.lit(0.0))) for b, fb in bands.items()}
    new |= {a: F.col(a) / (1.0 - f) for a in amplitudes}
    return j.withColumns(new)


def mission_seconds(t, ref_mjd: float) -> Column:
    return (col(t) - F.lit(float(ref_mjd))) * 86400.0


def mjd_from_seconds(t, ref_mjd: float) -> Column:
    return F.lit(float(ref_mjd)) + col(t) / 86400.0


def tt_minus_utc(t) -> Column:
    """Seconds between terrestrial time and UTC at a date (MJD)."""
    return F.lit(TT_MINUS_TAI + LEAP_FIRST - 1) + step_bin(t, LEAP_MJD)


def utc_from_tt(t) -> Column:
    return col(t) - tt_minus_utc(t) / 86400.0


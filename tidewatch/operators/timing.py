"""From event lists to light curves, bursts, segment count cubes, cospectra and per-observation variability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import ratio, signed_sqrt, sinc_squared
from tidewatch.operators.intervals import good_intervals
from tidewatch.operators.ordered import cells_for, latest_before, percentiles, scan
from tidewatch.session import cut, spread


# ---- light curves ----

def rebin_complete(rows: DataFrame, keys: Sequence[str], t: str, count: str, width: float, per_bin: int) -> DataFrame:
    """Fine bins summed into coarse ones; a coarse bin counts only when all of its fine bins are present."""
    first = rows.groupBy(*keys).agg(F.floor(F.min(t)).alias("_t0"))
    d = rows.join(first, list(keys)).withColumn("bin", F.floor((F.col(t) - F.col("_t0")) / F.lit(float(width))))
    g = d.groupBy(*keys, "bin").agg(F.sum(count).alias("c"), F.count(F.lit(1)).alias("_n"), F.max("_t0").alias("_t0"))
    return g.where(F.col("_n") == per_bin).withColumn("tc", F.col("_t0") + (F.col("bin") + 0.5) * F.lit(float(width))).drop("_n", "_t0")


def in_intervals(events: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Events with the (disjoint) interval that holds them: start <= t < stop."""
    d = latest_before(events, intervals.withColumn("_iv", F.struct("start", "stop")), keys, t, "start", {"_iv": ("last", "_iv")}, strict=False)
    return d.where(F.col(t) < F.col("_iv.stop")).select(*[c for c in d.columns if c != "_iv"], "_iv.*")


def light_curve(events: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, width: float) -> DataFrame:
    """Counts in whole bins of the good intervals, empty bins kept as 0. Bins start at each interval start."""
    w = F.lit(float(width))
    hit = in_intervals(events.select(*keys, t), intervals, keys, t)
    hit = hit.withColumn("bin", F.floor((F.col(t) - F.col("start")) / w)).where(F.col("bin") < F.floor((F.col("stop") - F.col("start")) / w))
    n = F.floor((F.col("stop") - F.col("start")) / w)
    empty = intervals.where(n >= 1).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    both = hit.select(*keys, "start", "bin", F.lit(1).alias("c")).unionByName(empty.select(*keys, "start", "bin", F.lit(0).alias("c")))
    g = both.groupBy(*keys, "start", "bin").agg(F.sum("c").alias("c"))
    return g.withColumn("tc", F.col("start") + (F.col("bin") + 0.5) * w)


# ---- bursts ----

def burst_candidates(lc: DataFrame, keys: Sequence[str], t: str, r: str, n_sigma: float, merge_gap: float) -> DataFrame:
    """Bins above mean + n sigma (population), with the time of the first bin of their event."""
    stats = lc.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"))
    hot = lc.join(stats, list(keys)).where(F.col(r) > F.col("_m") + n_sigma * F.col("_s")).select(*keys, t, r)
    n = cells_for(hot, keys)
    hot = scan(hot, keys, t, running={"_prev": ("last", F.col(t), False)}, n_cells=n)
    head = F.when(F.col("_prev").isNull() | (F.col(t) - F.col("_prev") >= merge_gap), F.col(t))
    return scan(hot.withColumn("_head", head), keys, t, running={"first": ("max", F.col("_head"), True)}, n_cells=n).drop("_prev", "_head")


def nearest_crossing(queries: DataFrame, lc: DataFrame, keys: Sequence[str], t: str, r: str, block: float) -> DataFrame:
    """Nearest bin before (side -1) or after (side 1) ``at`` with r below ``level`` (or equal, when ``equal``).

    queries: keys, qid, at, side, level, equal. The search goes through block minima in steps that double, so a query costs as much as
    its distance; nothing pairs a query with the whole light curve.
    """
    below = (F.col(r) < F.col("level")) | (F.col("equal") & (F.col(r) == F.col("level")))
    low = (F.col("_low") < F.col("level")) | (F.col("equal") & (F.col("_low") == F.col("level")))
    bins = lc.select(*keys, t, r).withColumn("_b", F.floor(F.col(t) / block))
    minima = bins.groupBy(*keys, "_b").agg(F.min(r).alias("_low"))
    lo, hi = bins.agg(F.min("_b"), F.max("_b")).first()
    span = (hi - lo) if lo is not None else 0
    q = queries.withColumn("_home", F.floor(F.col("at") / block))
    found, a, b = None, 0, 2
    while True:
        if a == 0:
            hit = q.withColumn("_b", F.explode(F.array(F.col("_home"), F.col("_home") + F.col("side"))))
        else:
            far = q.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda i: F.col("_home") + i * F.col("side"))))
            far = far.join(minima, [*keys, "_b"]).where(low)
            best = F.min((F.col("_b") - F.col("_home")) * F.col("side"))
            hit = far.groupBy(*queries.columns, "_home").agg(best.alias("_d")).withColumn("_b", F.col("_home") + F.col("_d") * F.col("side")).drop("_d")
        hit = hit.join(bins, [*keys, "_b"]).where(below & ((F.col(t) - F.col("at")) * F.col("side") > 0))
        step = hit.groupBy(*keys, "qid").agg((F.min((F.col(t) - F.col("at")) * F.col("side")) * F.first("side")).alias("_off"), F.first("at").alias("_at"))
        step = step.select(*keys, "qid", (F.col("_at") + F.col("_off")).alias("hit_t"))
        found = step if found is None else found.unionByName(step)
        if b > span:
            return found
        q = cut(q.join(step.select(*keys, "qid"), [*keys, "qid"], "left_anti"))
        if q.limit(1).count() == 0:
            return found
        a, b = b, b * 2


def burst_shapes(lc: DataFrame, keys: Sequence[str], t: str, r: str, dt: float, n_sigma: float, merge_gap: float, pre_window: float,
                 block_bins: int = 64) -> DataFrame:
    """Per event: peak, persistent level, rise, half decay, 10 % end and contiguous width above a quarter of the peak height."""
    lc = cut(lc.select(*keys, F.col(t).cast("double").alias("_t"), F.col(r).cast("double").alias("_r")))
    ev = burst_candidates(lc, keys, "_t", "_r", n_sigma, merge_gap).groupBy(*keys, "first").agg(
        F.max_by("_t", F.struct(F.col("_r"), -F.col("_t"))).alias("t_peak"), F.max("_r").alias("peak"))
    w = F.lit(float(pre_window))
    near = ev.select(*keys, "first").withColumn("_b", F.explode(F.array(F.floor(F.col("first") / w), F.floor(F.col("first") / w) - 1)))
    pre = near.join(lc.withColumn("_b", F.floor(F.col("_t") / w)), [*keys, "_b"])
    pre = pre.where((F.col("_t") >= F.col("first") - w) & (F.col("_t") < F.col("first")))
    pre = pre.groupBy(*keys, "first").agg(F.count(F.lit(1)).alias("_np"), F.percentile("_r", F.lit(0.5)).alias("_pm"))
    whole = percentiles(lc, keys, "_r", {"_gm": 0.5}).join(lc.groupBy(*keys).agg(F.min("_t").alias("_t_min"), F.max("_t").alias("_t_max")), list(keys))
    ev = ev.join(pre, [*keys, "first"], "left").join(whole, list(keys))
    ev = ev.withColumn("level", F.when(F.col("_np") >= pre_window / dt, F.col("_pm")).otherwise(F.col("_gm")))
    ev = cut(ev.withColumn("_amp", F.col("peak") - F.col("level")))

    def ask(name, side, share, equal):
        return F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), (F.col("level") + share * F.col("_amp")).alias("lv"), F.lit(equal).alias("equal"))

    asks = F.array(ask("before", -1, 0.25, False), ask("half", 1, 0.5, False), ask("tenth", 1, 0.1, False), ask("left", -1, 0.25, True), ask("right", 1, 0.25, True))
    q = ev.select(*keys, "first", F.col("t_peak").alias("at"), F.explode(asks).alias("a"))
    q = q.select(*keys, F.struct("first", F.col("a.q").alias("q")).alias("qid"), "at", F.col("a.side").alias("side"), F.col("a.lv").alias("level"), F.col("a.equal").alias("equal"))
    ans = nearest_crossing(q, lc, keys, "_t", "_r", block_bins * dt)
    ans = ans.groupBy(*keys, F.col("qid.first").alias("first")).agg(
        *[F.max(F.when(F.col("qid.q") == n, F.col("hit_t"))).alias(f"_{n}") for n in ("before", "half", "tenth", "left", "right")])
    runs = good_intervals(lc, keys, "_t", 1.49 * dt)
    ev = latest_before(ev.join(ans, [*keys, "first"], "left"), runs.withColumn("_run", F.struct("start", "stop")), keys, "t_peak", "start", {"_run": ("last", "_run")}, strict=False)
    left = F.greatest(F.coalesce(F.col("_left") + dt, F.col("_t_min")), F.coalesce(F.col("_run.start"), F.col("t_peak")))
    right = F.least(F.coalesce(F.col("_right") - dt, F.col("_t_max")), F.coalesce(F.col("_run.stop"), F.col("t_peak")))
    return ev.select(*keys, "t_peak", "peak", "level", F.when(F.col("level") > 0, F.col("peak") / F.col("level")).alias("peak_ratio"),
                     (F.col("t_peak") - F.col("_before")).alias("rise"), (F.col("_half") - F.col("t_peak")).alias("half_decay"),
                     (F.round((right - left) / dt) + 1).cast("long").alias("width_bins"),
                     F.coalesce("_before", "_t_min").alias("burst_start"), F.coalesce("_tenth", "_t_max").alias("burst_end"))


def accept_bursts(shapes: DataFrame, min_ratio: float, max_rise: float, decay: tuple[float, float], min_width: int) -> DataFrame:
    ok = ((F.col("level") > 0) & (F.col("peak") >= min_ratio * F.col("level")) & (F.col("rise") <= max_rise)
          & F.col("half_decay").between(*decay) & (F.col("width_bins") >= min_width))
    return shapes.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def burst_flags(bursts: DataFrame, lc: DataFrame, keys: Sequence[str], dt: float) -> DataFrame:
    """Per observation: number of accepted events, flag and share of the observed time inside them."""
    total = lc.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(float(dt))).alias("_T"))
    g = bursts.where("accepted").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("burst_end") - F.col("burst_start")).alias("_s"))
    j = total.join(g, list(keys), "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return j.select(*keys, n.alias("n_bursts"), (n > 0).alias("has_burst"), F.coalesce(F.col("_s") / F.col("_T"), F.lit(0.0)).alias("burst_fraction"))


def exclusion_windows(bursts: DataFrame, keys: Sequence[str], start: str, stop: str, before: float, after: float, origin: str) -> DataFrame:
    return bursts.select(*keys, (F.col(start) - before).alias("start"), (F.col(stop) + after).alias("stop"), F.lit(origin).alias("origin"))


# ---- count cubes and spectra ----

def count_cube(events: DataFrame, segs: DataFrame, keys: Sequence[str], t: str, det: str, dt: float, n_bins: int, detectors: tuple[int, int]) -> DataFrame:
    """Sparse counts per (segment, detector, bin); events outside the detector range or the segments are dropped."""
    s = segs.select(*keys, F.col("t0").alias("start"), (F.col("t0") + n_bins * dt).alias("stop"))
    e = in_intervals(events.select(*keys, t, det).where(F.col(det).between(*detectors)), s, keys, t)
    k = F.floor((F.col(t) - F.col("start")) / dt).cast("int")
    return e.withColumn("k", k).where(k < n_bins).groupBy(*keys, F.col("start").alias("t0"), F.col(det).alias("det"), "k").agg(F.count(F.lit(1)).alias("n"))


def detectors_on(cube: DataFrame, keys: Sequence[str], n_bins: int, blocks: int) -> DataFrame:
    """Detectors of a segment with counts in every block, with their totals."""
    block = F.floor(F.col("k") / (n_bins // blocks))
    full = 2 ** blocks - 1
    g = cube.groupBy(*keys, "t0", "det").agg(F.bit_or(F.pow(F.lit(2), block).cast("long")).alias("_m"), F.sum("n").alias("total"))
    return g.where(F.col("_m") == full).drop("_m")


def dft_sums(cube: DataFrame, keys: Sequence[str], n_bins: int, js: Sequence[int]) -> DataFrame:
    """Fourier coefficients by sums over the non-empty bins: no zeros are built and partial sums combine before the shuffle."""
    d = cube.withColumn("j", F.explode(F.array(*[F.lit(j) for j in js])))
    phase = F.lit(2.0 * math.pi / n_bins) * ((F.col("k") * F.col("j")) % n_bins)
    return d.groupBy(*keys, "t0", "det", "j").agg(F.sum(F.col("n") * F.cos(phase)).alias("re"), F.sum(-F.col("n") * F.sin(phase)).alias("im"))


def dft_fft(cube: DataFrame, keys: Sequence[str], n_bins: int, js: Sequence[int]) -> DataFrame:
    """The same coefficients by FFT for long segments; one row per (segment, detector) holds at most n_bins pairs."""
    import numpy as np

    lo, hi = min(js), max(js)
    rows = cube.groupBy(*keys, "t0", "det").agg(F.collect_list("k").alias("ks"), F.collect_list(F.col("n").cast("double")).alias("ns"))
    heads = [*keys, "t0", "det"]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in heads) + ", re array<double>, im array<double>"

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), n_bins))
            for i, (k, n) in enumerate(zip(b["ks"], b["ns"])):
                x[i, np.asarray(k, dtype=int)] = n
            z = np.fft.rfft(x, axis=1)[:, lo:hi + 1]
            out = b[heads].copy()
            out["re"], out["im"] = list(z.real), list(z.imag)
            yield out

    d = rows.mapInPandas(transform, schema)
    d = d.select(*heads, F.posexplode(F.arrays_zip("re", "im")).alias("_p", "z"))
    d = d.select(*heads, (F.col("_p") + lo).alias("j"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))
    return d.where(F.col("j").isin(list(js)))


def _band_columns(bands: Mapping[str, tuple[int, int]], value: Column, n_bins: int) -> list[Column]:
    """Binning-corrected band sums normalised by 2 / N^2."""
    v = value / sinc_squared("j", n_bins) * F.lit(2.0 / n_bins ** 2)
    return [F.sum(F.when(F.col("j").between(a, b), v)).alias(f"num_{k}") for k, (a, b) in bands.items()]


def _means(on: DataFrame, keys, n_bins: int, background: float) -> DataFrame:
    """Per segment: number of detectors, sums of the net means and of their squares, total counts, and whether all are positive."""
    s = F.col("total") / F.lit(float(n_bins)) - background
    return on.groupBy(*keys, "t0").agg(F.count(F.lit(1)).alias("n_on"), F.sum(s).alias("_s"), F.sum(s * s).alias("_ss"), F.min(s).alias("_lo"), F.sum("total").alias("counts"))


def pair_segments(coef: DataFrame, on: DataFrame, keys: Sequence[str], bands: Mapping[str, tuple[int, int]], n_bins: int, background: float = 0.0) -> DataFrame:
    """All-pairs cospectrum per segment through (|sum X|^2 - sum |X|^2) / 2, without joining detectors to each other."""
    c = coef.join(on.select(*keys, "t0", "det"), [*keys, "t0", "det"])
    g = c.groupBy(*keys, "t0", "j").agg(F.sum("re").alias("r"), F.sum("im").alias("i"), F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    cross = (F.col("r") * F.col("r") + F.col("i") * F.col("i") - F.col("p")) / 2.0
    b = g.groupBy(*keys, "t0").agg(*_band_columns(bands, cross, n_bins))
    m = _means(on, keys, n_bins, background).where("n_on >= 2 and _lo > 0")
    return b.join(m, [*keys, "t0"]).withColumn("den", (F.col("_s") * F.col("_s") - F.col("_ss")) / 2.0).drop("_s", "_ss", "_lo")


def hybrid_segments(coef: DataFrame, on: DataFrame, keys: Sequence[str], bands, n_bins: int, max_counts: float, background: float = 0.0) -> DataFrame:
    """Pairs where at least two detectors are on, else the single detector's power minus its Poisson level below a rate cap."""
    pairs = pair_segments(coef, on, keys, bands, n_bins, background).withColumn("kind", F.lit("pairs"))
    m = _means(on, keys, n_bins, background).where((F.col("n_on") == 1) & (F.col("_lo") > 0) & (F.col("counts") <= max_counts))
    one = coef.join(on.select(*keys, "t0", "det"), [*keys, "t0", "det"]).join(m, [*keys, "t0"])
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im") - F.col("counts")
    s = one.groupBy(*keys, "t0").agg(*_band_columns(bands, power, n_bins), F.first("n_on").alias("n_on"), F.first("counts").alias("counts"), F.first("_ss").alias("den"))
    return pairs.unionByName(s.withColumn("kind", F.lit("single")))


def two_group_segments(coef: DataFrame, on: DataFrame, keys: Sequence[str], bands, n_bins: int, background: float = 0.0) -> DataFrame:
    """Cospectrum of two detector groups, alternating in detector order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "t0").orderBy("det")
    grp = on.withColumn("g", (F.row_number().over(w) - 1) % 2)
    a, b = F.col("g") == 0, F.col("g") == 1
    c = coef.join(grp.select(*keys, "t0", "det", "g"), [*keys, "t0", "det"])
    z = c.groupBy(*keys, "t0", "j").agg(*[F.sum(F.when(s, F.col(p))).alias(f"{p}{i}") for i, s in enumerate((a, b)) for p in ("re", "im")])
    bsum = z.groupBy(*keys, "t0").agg(*_band_columns(bands, F.col("re0") * F.col("re1") + F.col("im0") * F.col("im1"), n_bins))
    s = F.col("total") / F.lit(float(n_bins)) - background
    m = grp.groupBy(*keys, "t0").agg(F.count(F.lit(1)).alias("n_on"), F.sum(F.when(a, s)).alias("_x"), F.sum(F.when(b, s)).alias("_y"))
    return bsum.join(m.where("_x > 0 and _y > 0"), [*keys, "t0"]).withColumn("den", F.col("_x") * F.col("_y")).drop("_x", "_y")


# ---- per-observation features ----

def median_variance(segs: DataFrame, keys: Sequence[str], bands: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Median over segments of the fractional variance per band as signed root, with a status."""
    # one grouped median over (key, band), not one per band
    each = segs.select(*keys, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), ratio(f"num_{b}", "den").alias("_q")) for b in bands])).alias("_e")).select(*keys, "_e.*")
    mid = percentiles(each, [*keys, "band"], "_q", {"_v": 0.5})
    wide = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("_v"))).alias(f"v_{b}") for b in bands])
    g = segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(wide, list(keys), "left")
    ok = F.col("n_rows") >= min_rows
    out = [F.when(ok, signed_sqrt(f"v_{b}")).alias(b) for b in bands]
    return g.select(*keys, "n_rows", *out, F.when(ok, "ok").otherwise(f"missing (< {min_rows} valid rows)").alias("status"))


def mean_variance(segs: DataFrame, keys: Sequence[str], bands: Sequence[str], min_segs: int = 3) -> DataFrame:
    """Ratio of means per band with delta-method error; one aggregation for all bands."""
    d = F.col("den")
    aggs = [F.count(F.lit(1)).alias("n_seg"), F.sum(d).alias("_d"), F.sum(d * d).alias("_dd")]
    for b in bands:
        x = F.col(f"num_{b}")
        aggs += [F.sum(x).alias(f"_x{b}"), F.sum(x * x).alias(f"_xx{b}"), F.sum(x * d).alias(f"_xd{b}")]
    g = segs.groupBy(*keys).agg(*aggs)
    ok, out = F.col("n_seg") >= min_segs, []
    for b in bands:
        r = ratio(f"_x{b}", "_d")
        left = F.greatest(F.lit(0.0), F.col(f"_xx{b}") - 2.0 * r * F.col(f"_xd{b}") + r * r * F.col("_dd"))
        se = F.try_divide(F.sqrt(left * F.col("n_seg") / F.greatest(F.col("n_seg") - 1, F.lit(1))), F.abs("_d"))
        out += [F.when(ok, r).alias(f"{b}_var"), F.when(ok, se).alias(f"{b}_se"), F.when(ok, signed_sqrt(r)).alias(b)]
    status = F.when(ok, "ok").otherwise(f"missing (< {min_segs} valid segments)")
    return g.select(*keys, "n_seg", *out, status.alias("status"))


def log_bands(n_bins: int, count: int) -> list[tuple[int, int]]:
    """Inclusive index ranges between rounded geometric edges, repeated edges dropped."""
    top = n_bins // 2
    edges = sorted({round(top ** (i / count)) for i in range(count + 1)})
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def octave_bands(count: int) -> list[tuple[int, int]]:
    return [(2 ** k, 2 ** (k + 1) - 1) for k in range(count)]


def centroid(variances: Sequence[str], centres: Sequence[float], min_rms: float, widths: Sequence[float] | None = None) -> Column:
    """Variance-weighted geometric mean frequency; negative weights are clipped, missing below the rms floor.

    widths: divide the weights by these logarithmic widths, or leave them as they are.
    """
    w = [F.greatest(F.col(v), F.lit(0.0)) / F.lit(1.0 if widths is None else float(widths[i])) for i, v in enumerate(variances)]
    total, weight, moment = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i, v in enumerate(variances):
        total, weight = total + F.col(v), weight + w[i]
        moment = moment + w[i] * math.log(centres[i])
    rms = F.sqrt(F.greatest(total, F.lit(0.0)))
    return F.when((rms >= min_rms) & (weight > 0), F.exp(F.try_divide(moment, weight)))


def null_status(df: DataFrame, var: str, se: str, n: str, min_segs: int, max_z: float) -> DataFrame:
    """z of a band that must be empty, and the resulting status."""
    z = ratio(var, se)
    status = (F.when(F.col(n) < min_segs, f"missing (< {min_segs} valid segments)")
              .when(z.isNull() | (F.abs(z) > max_z), f"excluded (null band |z| > {max_z:g})").otherwise("ok"))
    return df.withColumns({"null_z": z, "status": status})


def segment_colours(events: DataFrame, segs: DataFrame, keys: Sequence[str], t: str, channel: str, length: float, bands: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Counts per channel band inside the given segments and the two colours."""
    s = segs.select(*keys, F.col("t0").alias("start"), (F.col("t0") + length).alias("stop"))
    e = in_intervals(events.select(*keys, t, channel), s, keys, t)
    c = F.col(channel)
    g = e.groupBy(*keys).agg(*[F.count(F.when((c >= lo) & (c < hi), 1)).alias(b) for b, (lo, hi) in bands.items()])
    a, b, d = list(bands)[:3]
    return g.withColumns({"c1": ratio(b, a), "c2": ratio(d, b)})


def ratio_screen(events: DataFrame, keys: Sequence[str], channel: str, high: tuple[int, int], low: tuple[int, int], bright: int, p: float) -> DataFrame:
    """High- over low-band counts; rows above the p-quantile of the bright rows are flagged."""
    c = F.col(channel)
    g = events.groupBy(*keys).agg(F.count(F.when((c >= high[0]) & (c < high[1]), 1)).alias("n_high"), F.count(F.when((c >= low[0]) & (c < low[1]), 1)).alias("n_low"))
    g = g.withColumn("ratio", ratio("n_high", "n_low"))
    row = percentiles(g.where(F.col("n_low") >= bright), [], "ratio", {"limit": p}).first()
    limit = F.lit(row["limit"] if row else None).cast("double")
    return g.withColumn("flagged", F.coalesce(F.col("ratio") > limit, F.lit(False)))


def halves(segs: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Ratio-of-means features of the even and odd segments of every key (segments in time order, from 0)."""
    from tidewatch.operators.ordered import row_index

    s = row_index(segs, keys, "t0", out="_i").withColumn("half", ((F.col("_i") - 1) % 2).cast("int"))
    return mean_variance(s, [*keys, "half"], bands, 1)


def lorentz_share(width: Column, lo: float, hi: float) -> Column:
    """Share of a zero-centred Lorentzian between two frequencies."""
    return F.lit(2.0 / math.pi) * (F.atan(F.lit(hi) / width) - F.atan(F.lit(lo) / width))


def fit_lorentzians(obs: DataFrame, keys: Sequence[str], values: Sequence[str], errors: Sequence[str], edges: Sequence[tuple[float, float]],
                    widths: Sequence[float], d_bic: float = 6.0, min_bins: int = 6) -> DataFrame:
    """One- and two-component fits of zero-centred Lorentzians on a grid of widths.

    For given widths the amplitudes are linear, so every grid cell has a closed-form weighted fit; amplitudes stay non-negative.
    The grid is explode-generated per row and reduced to the best cell before anything is shuffled further.
    """
    ok = [F.col(v).isNotNull() & (F.col(e) > 0) for v, e in zip(values, errors)]
    n = sum((o.cast("int") for o in ok), F.lit(0))
    base = obs.select(*keys, n.alias("n_bins"), F.array(*[F.when(o, F.col(v)) for o, v in zip(ok, values)]).alias("_y"),
                      F.array(*[F.when(o, 1.0 / (F.col(e) * F.col(e))) for o, e in zip(ok, errors)]).alias("_w")).where(F.col("n_bins") >= min_bins)
    shapes = [[2.0 / math.pi * (math.atan(hi / d) - math.atan(lo / d)) for lo, hi in edges] for d in widths]
    m = F.array(*[F.array(*[F.lit(x) for x in row]) for row in shapes])
    grid = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i in range(len(widths)) for k in range(i, len(widths))]
    d = spread(base, *keys).withColumn("_c", F.explode(F.array(*grid)))
    d = d.withColumns({"_a": F.element_at(m, F.col("_c.i") + 1), "_b": F.element_at(m, F.col("_c.k") + 1)})

    def dot(x, y):
        prod = F.zip_with(F.zip_with(F.col(x), F.col(y), lambda p, q: p * q), F.col("_w"), lambda p, q: p * q)
        return F.aggregate(prod, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    d = d.withColumns({"aa": dot("_a", "_a"), "ab": dot("_a", "_b"), "bb": dot("_b", "_b"), "ay": dot("_a", "_y"), "by": dot("_b", "_y"), "yy": dot("_y", "_y")})
    one = F.col("_c.i") == F.col("_c.k")
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    p, q = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det), F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    single = F.greatest(F.lit(1e-8), F.try_divide(F.col("ay"), F.col("aa")))
    d = d.withColumns({"r1": F.when(one, single).otherwise(p), "r2": F.when(one, F.lit(0.0)).otherwise(q)})
    d = d.where(one | ((F.col("r1") > 1e-8) & (F.col("r2") > 1e-8)))
    chi2 = (F.col("yy") - 2 * (F.col("r1") * F.col("ay") + F.col("r2") * F.col("by")) + F.col("r1") * F.col("r1") * F.col("aa")
            + F.col("r2") * F.col("r2") * F.col("bb") + 2 * F.col("r1") * F.col("r2") * F.col("ab"))
    d = d.withColumn("chi2", chi2)
    item, pos = F.struct("chi2", "_c.i", "_c.k", "r1", "r2"), F.struct("chi2", "_c.i", "_c.k")
    g = d.groupBy(*keys, "n_bins").agg(F.min_by(F.when(one, item), F.when(one, pos)).alias("f1"), F.min_by(F.when(~one, item), F.when(~one, pos)).alias("f2"))
    g = g.withColumns({"bic1": F.col("f1.chi2") + 2 * F.log("n_bins"), "bic2": F.col("f2.chi2") + 4 * F.log("n_bins")})
    two = F.coalesce(F.col("bic1") - F.col("bic2") > d_bic, F.lit(False))
    w = F.array(*[F.lit(float(x)) for x in widths])
    return g.select(*keys, "n_bins", F.when(two, 2).otherwise(1).alias("n_lor"), "bic1", "bic2",
                    F.element_at(w, F.when(two, F.col("f2.i")).otherwise(F.col("f1.i")) + 1).alias("nu_l"),
                    F.sqrt(F.when(two, F.col("f2.r1")).otherwise(F.col("f1.r1"))).alias("rms_l"))


def gain_shift(df: DataFrame, observed: Mapping[str, str], reference: Mapping[str, float]) -> DataFrame:
    """Relative shift at each calibration point and the largest of them."""
    d = df.withColumns({f"shift_{k}": F.col(c) / reference[k] - 1.0 for k, c in observed.items()})
    return d.withColumn("max_shift", F.greatest(*[F.abs(F.col(f"shift_{k}")) for k in observed]))


def interval_rates(binned: DataFrame, intervals: DataFrame, keys: Sequence[str], centre: str, dt: float, series: str, value: str) -> DataFrame:
    """Mean rate per series inside good time, counted by bin centres, and the time covered."""
    from tidewatch.operators.intervals import inside

    bins = binned.select(*keys, centre).distinct()
    cov = inside(bins, intervals, keys, centre)
    time = cov.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(float(dt))).alias("covered"))
    n = binned.join(cov, [*keys, centre]).groupBy(*keys, series).agg(F.sum(value).alias("_n"))
    return n.join(time, list(keys)).withColumn("rate", F.col("_n") / F.col("covered")).drop("_n")



def vector_at(arr: str, grid: Sequence[float], x: float) -> Column:
    """Linear interpolation of a vector column at one point of its grid, clamped at the ends."""
    i = max(0, min(len(grid) - 2, sum(g <= x for g in grid) - 1))
    f = max(0.0, min(1.0, (x - grid[i]) / (grid[i + 1] - grid[i])))
    a, b = F.element_at(arr, i + 1), F.element_at(arr, i + 2)
    return a + (b - a) * f

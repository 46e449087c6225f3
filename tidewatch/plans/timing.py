"""Event timing on the given events: six observations (user_id % 6), five detectors, hourly bins, segments of 64 bins."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import intervals as I
from tidewatch.operators import joins as J
from tidewatch.operators import ordered as O
from tidewatch.operators import timing as T
from tidewatch.operators.select import reliability
from tidewatch.plans.registry import query
from tidewatch.plans.views import EDGES, EVENTS, VECTORS, events, round_all, vectors
from tidewatch.session import cut

DT, N = 3600.0, 64
LEN = N * DT
JS = list(range(1, 32))
BANDS = {"t1": (1, 4), "t2": (5, 12), "t3": (13, 20), "state": (3, 16), "white": (24, 31)}
LOG = T.log_bands(N, 9)
OCT = T.octave_bands(5)
ALL = BANDS | {f"lb{i}": b for i, b in enumerate(LOG)} | {f"nu{i}": b for i, b in enumerate(OCT)}


def obs_events(spark, sf):
    return events(spark, sf).withColumn("obs", F.col("user_id") % 6)


def obs_intervals(spark, sf):
    return I.good_intervals(obs_events(spark, sf), ["obs"], "t", 43200.0)


def cube(spark, sf):
    """Counts per segment, detector and bin, stored once because coefficients, detector flags and means all read them."""
    segs = I.segments(obs_intervals(spark, sf), LEN)
    return cut(T.count_cube(obs_events(spark, sf), segs, ["obs"], "t", "det", DT, N, (0, 4)))


def pair_segments(spark, sf):
    c = cube(spark, sf)
    return cut(T.pair_segments(T.dft_sums(c, ["obs"], N, JS), T.detectors_on(c, ["obs"], N, 8), ["obs"], ALL, N))


OBSEV = EVENTS + """, oe AS (SELECT user_id % 6 AS obs, * FROM ev),
  ol AS (SELECT obs, t, CASE WHEN t - lag(t) OVER (PARTITION BY obs ORDER BY t) > 43200 THEN 1 ELSE 0 END AS cut FROM oe),
  og AS (SELECT obs, t, sum(cut) OVER (PARTITION BY obs ORDER BY t) AS g FROM ol), os AS (SELECT obs, min(t) AS start, max(t) AS stop FROM og GROUP BY obs, g)"""
OSEG = OBSEV + """, sg AS (SELECT obs, start + i * 230400e0 AS t0 FROM (SELECT obs, start, unnest(range(0, floor((stop - start) / 230400e0)::BIGINT)) AS i FROM os))"""
CUBE = OSEG + """, cube AS (SELECT o.obs, t0, det, floor((t - t0) / 3600e0)::INTEGER AS k, count(*)::DOUBLE AS n FROM oe o JOIN sg ON o.obs = sg.obs AND t >= t0 AND t < t0 + 230400e0
  GROUP BY ALL), onn AS (SELECT obs, t0, det, sum(n) AS total FROM cube GROUP BY ALL HAVING count(DISTINCT k // 8) = 8)"""
COEF = CUBE + """, coef AS (SELECT obs, t0, det, j, sum(n * cos(2e0 * pi() * ((k * j) % 64) / 64)) AS re, sum(-n * sin(2e0 * pi() * ((k * j) % 64) / 64)) AS im
  FROM cube, (SELECT unnest(range(1, 32))::INTEGER AS j) GROUP BY ALL)"""


def num_sql(value, bands):
    f = f"2e0 / 4096 * {value} / pow(sin(pi() * j / 64) / (pi() * j / 64), 2)"
    return ", ".join(f"sum(CASE WHEN j BETWEEN {a} AND {b} THEN {f} END) AS num_{k}" for k, (a, b) in bands.items())


PAIR = COEF + f""", pj AS (SELECT obs, t0, j, (pow(sum(re), 2) + pow(sum(im), 2) - sum(re * re + im * im)) / 2 AS c FROM coef JOIN onn USING (obs, t0, det) GROUP BY ALL),
  pm AS (SELECT obs, t0, count(*) AS n_on, sum(total / 64) AS s, sum(pow(total / 64, 2)) AS ss, sum(total) AS counts FROM onn GROUP BY ALL),
  pb AS (SELECT obs, t0, {num_sql('c', ALL)} FROM pj GROUP BY ALL),
  sgm AS (SELECT pb.*, n_on, counts, (s * s - ss) / 2 AS den FROM pb JOIN pm USING (obs, t0) WHERE n_on >= 2)"""


def ratio_sql(bands, table="sgm", extra="", status=3):
    """Ratio of means and its error per band."""
    r = ", ".join(f"sum(num_{b}) / sum(den) AS r_{b}" for b in bands)
    e = ", ".join(f"sqrt(sum(pow(num_{b} - r_{b} * den, 2)) * count(*) / greatest(count(*) - 1, 1)) / sum(den) AS e_{b}" for b in bands)
    keep = ", ".join(f"r_{b}" for b in bands)
    return f"""rm AS (SELECT obs{extra}, {r} FROM {table} GROUP BY ALL), mv AS (SELECT obs{extra}, count(*) AS n_seg, {keep}, {e} FROM {table} JOIN rm USING (obs{extra}) GROUP BY obs{extra}, {keep})"""


# ---- light curves and bursts ----

@query("t8_rebin_complete", f"""WITH {EVENTS}, b AS (SELECT det, floor(t / 1800e0) * 1800e0 AS tb, count(*) AS n FROM ev GROUP BY ALL), z AS (SELECT det, floor(min(tb)) AS t0 FROM b GROUP BY 1),
  g AS (SELECT det, t0, floor((tb - t0) / 7200e0)::BIGINT AS bin, sum(n)::BIGINT AS c, count(*) AS m FROM b JOIN z USING (det) GROUP BY ALL)
  SELECT det, bin, c, t0 + (bin + 0.5) * 7200e0 AS tc FROM g WHERE m = 4""")
def t8(spark, sf):
    b = events(spark, sf).groupBy("det", (F.floor(F.col("t") / 1800.0) * 1800.0).alias("tb")).agg(F.count(F.lit(1)).alias("n"))
    return T.rebin_complete(b, ["det"], "tb", "n", 7200.0, 4)


def curve(spark, sf):
    return T.light_curve(obs_events(spark, sf), obs_intervals(spark, sf), ["obs"], "t", DT)


CURVE = OBSEV + """, bn AS (SELECT obs, start, unnest(range(0, floor((stop - start) / 3600e0)::BIGINT)) AS bin FROM os),
  ec AS (SELECT oe.obs, start, floor((t - start) / 3600e0)::BIGINT AS bin, count(*) AS c FROM oe JOIN os ON oe.obs = os.obs AND t >= start AND t < stop GROUP BY ALL),
  lc AS (SELECT obs, start, bin, start + (bin + 0.5) * 3600e0 AS tc, coalesce(c, 0) AS c FROM bn LEFT JOIN ec USING (obs, start, bin))"""


@query("t9_light_curve", f"WITH {CURVE} SELECT obs, bin, round(tc, 6) AS tc, c FROM lc")
def t9(spark, sf):
    return round_all(curve(spark, sf).select("obs", "bin", "tc", "c"))


HOT = CURVE + """, st AS (SELECT obs, avg(c) AS m, stddev_pop(c) AS s FROM lc GROUP BY 1), ht AS (SELECT lc.obs, tc, c FROM lc JOIN st USING (obs) WHERE c > m + 2 * s),
  hh AS (SELECT *, CASE WHEN tc - lag(tc) OVER (PARTITION BY obs ORDER BY tc) < 10800 THEN NULL ELSE tc END AS head FROM ht),
  he AS (SELECT obs, tc, c, max(head) OVER (PARTITION BY obs ORDER BY tc) AS first FROM hh)"""


@query("t10_burst_candidates", f"WITH {HOT} SELECT obs, round(tc, 6) AS tc, c, round(first, 6) AS first FROM he")
def t10(spark, sf):
    return round_all(T.burst_candidates(curve(spark, sf), ["obs"], "tc", "c", 2.0, 10800.0))


def shapes(spark, sf):
    return T.burst_shapes(curve(spark, sf), ["obs"], "tc", "c", DT, 2.0, 10800.0, 86400.0, block_bins=16)


SHAPE = HOT + """, pk AS (SELECT obs, first, tc AS t_peak, c::DOUBLE AS peak FROM (SELECT *, row_number() OVER (PARTITION BY obs, first ORDER BY c DESC, tc) AS rn FROM he) WHERE rn = 1),
  md AS (SELECT obs, median(c) AS gm, min(tc) AS t_min, max(tc) AS t_max FROM lc GROUP BY 1), rn AS (SELECT obs, start, min(tc) AS r0, max(tc) AS r1 FROM lc GROUP BY 1, 2),
  pr AS (SELECT pk.obs, pk.first, count(*) AS np, median(c) AS pm FROM pk JOIN lc ON lc.obs = pk.obs AND lc.tc >= pk.first - 86400 AND lc.tc < pk.first GROUP BY ALL),
  lv AS (SELECT pk.*, md.*, r0, r1, CASE WHEN np >= 24 THEN pm ELSE gm END AS level FROM pk JOIN md USING (obs) LEFT JOIN pr USING (obs, first) JOIN rn ON rn.obs = pk.obs AND t_peak BETWEEN r0 AND r1),
  cr AS (SELECT lv.obs, lv.first, max(CASE WHEN tc < t_peak AND c < level + 0.25e0 * (peak - level) THEN tc END) AS bef, min(CASE WHEN tc > t_peak AND c < level + 0.5e0 * (peak - level) THEN tc END) AS half,
  min(CASE WHEN tc > t_peak AND c < level + 0.1e0 * (peak - level) THEN tc END) AS tenth, max(CASE WHEN tc < t_peak AND c <= level + 0.25e0 * (peak - level) THEN tc END) AS lft,
  min(CASE WHEN tc > t_peak AND c <= level + 0.25e0 * (peak - level) THEN tc END) AS rgt FROM lv JOIN lc ON lc.obs = lv.obs GROUP BY ALL),
  sh AS (SELECT lv.obs, t_peak, peak, level, CASE WHEN level > 0 THEN peak / level END AS peak_ratio, t_peak - bef AS rise, half - t_peak AS half_decay,
  (round((least(coalesce(rgt - 3600, t_max), r1) - greatest(coalesce(lft + 3600, t_min), r0)) / 3600) + 1)::BIGINT AS width_bins, coalesce(bef, t_min) AS burst_start, coalesce(tenth, t_max) AS burst_end
  FROM lv JOIN cr USING (obs, first)),
  ac AS (SELECT *, coalesce(level > 0 AND peak >= 1.5e0 * level AND rise <= 36000 AND half_decay BETWEEN 3600 AND 108000 AND width_bins >= 2, false) AS accepted FROM sh)"""


@query("t11_burst_shapes", f"""WITH {SHAPE} SELECT obs, round(t_peak, 4) AS t_peak, round(peak, 4) AS peak, round(level, 4) AS level, round(peak_ratio, 4) AS peak_ratio, round(rise, 4) AS rise,
  round(half_decay, 4) AS half_decay, width_bins, round(burst_start, 4) AS burst_start, round(burst_end, 4) AS burst_end FROM sh""")
def t11(spark, sf):
    return round_all(shapes(spark, sf), 4)


def accepted(spark, sf):
    return T.accept_bursts(shapes(spark, sf), 1.5, 36000.0, (3600.0, 108000.0), 2)


@query("t12_burst_flags", f"""WITH {SHAPE} SELECT obs, coalesce(n, 0) AS n_bursts, coalesce(n, 0) > 0 AS has_burst, round(coalesce(s / total, 0), 9) AS burst_fraction
  FROM (SELECT obs, count(*) * 3600e0 AS total FROM lc GROUP BY 1) LEFT JOIN (SELECT obs, count(*) AS n, sum(burst_end - burst_start) AS s FROM ac WHERE accepted GROUP BY 1) USING (obs)""")
def t12(spark, sf):
    return round_all(T.burst_flags(accepted(spark, sf), curve(spark, sf), ["obs"], DT), 9)


@query("t13_exclusion_windows", f"""WITH {SHAPE} SELECT obs, round(burst_start - 3600, 4) AS start, round(burst_end + 7200, 4) AS stop, 'curve' AS origin FROM ac WHERE accepted
  UNION ALL SELECT obs, round(t - 600, 4), round(t + 1200, 4), 'list' FROM oe WHERE event_type = 'error' AND value > 200""")
def t13(spark, sf):
    a = T.exclusion_windows(accepted(spark, sf).where("accepted"), ["obs"], "burst_start", "burst_end", 3600.0, 7200.0, "curve")
    e = obs_events(spark, sf).where("event_type = 'error' and value > 200")
    return round_all(a.unionByName(T.exclusion_windows(e, ["obs"], "t", "t", 600.0, 1200.0, "list")), 4)


# ---- segments and spectra ----

@query("t14_detectors_on", f"WITH {CUBE} SELECT obs, round(t0, 6) AS t0, det, total::BIGINT AS total FROM onn")
def t14(spark, sf):
    return round_all(T.detectors_on(cube(spark, sf), ["obs"], N, 8))


@query("t15_count_cube", f"WITH {CUBE} SELECT obs, round(t0, 6) AS t0, det, k, n::BIGINT AS n FROM cube")
def t15(spark, sf):
    return round_all(cube(spark, sf))


COEF_OUT = f"WITH {COEF} SELECT obs, round(t0, 6) AS t0, det, j, round(re, 6) AS re, round(im, 6) AS im FROM coef"


@query("t16_fourier_sums", COEF_OUT)
def t16(spark, sf):
    return round_all(T.dft_sums(cube(spark, sf), ["obs"], N, JS))


@query("t16_fourier_fft", COEF_OUT)
def t16b(spark, sf):
    return round_all(T.dft_fft(cube(spark, sf), ["obs"], N, JS))


@query("t17_two_group_cospectrum", f"""WITH {COEF}, gr AS (SELECT *, (row_number() OVER (PARTITION BY obs, t0 ORDER BY det) - 1) % 2 AS g FROM onn),
  z AS (SELECT obs, t0, j, sum(CASE WHEN g = 0 THEN re END) * sum(CASE WHEN g = 1 THEN re END) + sum(CASE WHEN g = 0 THEN im END) * sum(CASE WHEN g = 1 THEN im END) AS c
  FROM coef JOIN gr USING (obs, t0, det) GROUP BY ALL), b AS (SELECT obs, t0, {num_sql('c', BANDS)} FROM z GROUP BY ALL),
  m AS (SELECT obs, t0, count(*) AS n_on, sum(CASE WHEN g = 0 THEN total / 64 END) AS x, sum(CASE WHEN g = 1 THEN total / 64 END) AS y FROM gr GROUP BY ALL)
  SELECT obs, round(t0, 6) AS t0, n_on, round(num_t1, 6) AS num_t1, round(num_t2, 6) AS num_t2, round(num_t3, 6) AS num_t3, round(num_state, 6) AS num_state, round(num_white, 6) AS num_white,
  round(x * y, 6) AS den FROM b JOIN m USING (obs, t0) WHERE x > 0 AND y > 0""")
def t17(spark, sf):
    c = cube(spark, sf)
    return round_all(T.two_group_segments(T.dft_sums(c, ["obs"], N, JS), T.detectors_on(c, ["obs"], N, 8), ["obs"], BANDS, N))


SEG_COLS = ["num_t1", "num_t2", "num_t3", "num_state", "num_white", "den"]
SEG_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in SEG_COLS)


@query("t18_all_pairs_cospectrum", f"WITH {PAIR} SELECT obs, round(t0, 6) AS t0, n_on, {SEG_OUT} FROM sgm")
def t18(spark, sf):
    return round_all(pair_segments(spark, sf).select("obs", "t0", "n_on", *SEG_COLS))


HYBRID = f"""{PAIR}, sj AS (SELECT obs, t0, j, re * re + im * im - total AS c, pow(total / 64, 2) AS den FROM coef JOIN onn USING (obs, t0, det) JOIN pm USING (obs, t0) WHERE n_on = 1 AND total <= 500),
  sb AS (SELECT obs, t0, {num_sql('c', BANDS)}, max(den) AS den FROM sj GROUP BY ALL)"""


@query("t19_single_detector_hybrid", f"""WITH {HYBRID} SELECT obs, round(t0, 6) AS t0, 'pairs' AS kind, n_on, {SEG_OUT} FROM sgm
  UNION ALL SELECT obs, round(t0, 6), 'single', 1, {", ".join(f"round({c}, 6)" for c in SEG_COLS)} FROM sb""")
def t19(spark, sf):
    c = cube(spark, sf)
    h = T.hybrid_segments(T.dft_sums(c, ["obs"], N, JS), T.detectors_on(c, ["obs"], N, 8), ["obs"], BANDS, N, 500)
    return round_all(h.select("obs", "t0", "kind", "n_on", *SEG_COLS))


@query("t20_band_sums", f"WITH {PAIR} SELECT obs, round(t0, 6) AS t0, {', '.join(f'round(num_lb{i}, 6) AS num_lb{i}' for i in range(len(LOG)))} FROM sgm")
def t20(spark, sf):
    return round_all(pair_segments(spark, sf).select("obs", "t0", *[f"num_lb{i}" for i in range(len(LOG))]))


def sroot(x):
    return f"sign({x}) * sqrt(abs({x}))"


MEDIANS = ", ".join(f"median(num_{b} / nullif(den, 0)) AS v_{b}" for b in ("t1", "t2", "t3"))


@query("t21_median_variance", f"""WITH {PAIR}, m AS (SELECT obs, count(*) AS n_rows, {MEDIANS} FROM sgm GROUP BY 1)
  SELECT obs, n_rows, {', '.join(f'CASE WHEN n_rows >= 3 THEN round({sroot(f"v_{b}")}, 6) END AS {b}' for b in ('t1', 't2', 't3'))},
  CASE WHEN n_rows >= 3 THEN 'ok' ELSE 'missing (< 3 valid rows)' END AS status FROM m""")
def t21(spark, sf):
    return round_all(T.median_variance(pair_segments(spark, sf), ["obs"], ["t1", "t2", "t3"]))


T22 = ["t1", "t2", "t3", "state", "white"]


@query("t22_mean_variance", f"""WITH {PAIR}, {ratio_sql(T22)} SELECT obs, n_seg, {', '.join(f'CASE WHEN n_seg >= 3 THEN round(r_{b}, 6) END AS {b}_var, CASE WHEN n_seg >= 3 THEN round(e_{b}, 6) END AS {b}_se, CASE WHEN n_seg >= 3 THEN round({sroot(f"r_{b}")}, 6) END AS {b}' for b in T22)},
  CASE WHEN n_seg >= 3 THEN 'ok' ELSE 'missing (< 3 valid segments)' END AS status FROM mv""")
def t22(spark, sf):
    return round_all(T.mean_variance(pair_segments(spark, sf), ["obs"], T22))


@query("t23_log_bands", f"""WITH {CUBE}, e AS (SELECT DISTINCT round(pow(32e0, i / 9e0))::INTEGER AS e FROM (SELECT unnest(range(0, 10)) AS i)), b AS (SELECT e AS first_j, lead(e) OVER (ORDER BY e) - 1 AS last_j FROM e)
  SELECT first_j, last_j, (SELECT count(*) FROM onn) AS n_on FROM b WHERE last_j IS NOT NULL""")
def t23(spark, sf):
    n = T.detectors_on(cube(spark, sf), ["obs"], N, 8).agg(F.count(F.lit(1)).alias("n_on"))
    band = F.explode(F.array(*[F.struct(F.lit(a).alias("first_j"), F.lit(b).alias("last_j")) for a, b in LOG])).alias("b")
    return n.select("n_on", band).select("b.first_j", "b.last_j", "n_on")


NU = [f"nu{i}" for i in range(5)]


def centroid_sql(cols, centres, floor, widths=None):
    w = [f"greatest({c}, 0) / {1.0 if widths is None else widths[i]!r}" for i, c in enumerate(cols)]
    import math

    moment = " + ".join(f"{x} * {math.log(centres[i])!r}" for i, x in enumerate(w))
    return f"CASE WHEN sqrt(greatest({' + '.join(cols)}, 0)) >= {floor} AND {' + '.join(w)} > 0 THEN exp(({moment}) / nullif({' + '.join(w)}, 0)) END"


OCT_C = [2 ** (i + 0.5) for i in range(5)]


@query("t24_octave_centroid", f"WITH {PAIR}, {ratio_sql(NU)} SELECT obs, round({centroid_sql([f'r_{b}' for b in NU], OCT_C, 0.05)}, 6) AS nu_c FROM mv WHERE n_seg >= 3")
def t24(spark, sf):
    m = T.mean_variance(pair_segments(spark, sf), ["obs"], NU).where("status = 'ok'")
    return round_all(m.select("obs", T.centroid([f"{b}_var" for b in NU], OCT_C, 0.05).alias("nu_c")))


LB = [f"lb{i}" for i in range(len(LOG))]
LOG_C = [(a * b) ** 0.5 for a, b in LOG]


def log_widths():
    import math

    return [math.log((b + 0.5) / (a - 0.5)) for a, b in LOG]


@query("t24_width_centroid", f"""WITH {PAIR}, m AS (SELECT obs, {', '.join(f'median(num_{b} / den) AS v_{b}' for b in LB)} FROM sgm GROUP BY 1 HAVING count(*) >= 3)
  SELECT obs, round({centroid_sql([f'v_{b}' for b in LB], LOG_C, 0.01, log_widths())}, 6) AS nu_c FROM m""")
def t24b(spark, sf):
    s = pair_segments(spark, sf)
    m = s.groupBy("obs").agg(F.count(F.lit(1)).alias("n"))
    long = s.select("obs", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), C.ratio(f"num_{b}", "den").alias("v")) for i, b in enumerate(LB)])).alias("e"))
    med = O.percentiles(long.select("obs", "e.i", "e.v"), ["obs", "i"], "v", {"m": 0.5})
    wide = med.groupBy("obs").agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"v_{b}") for i, b in enumerate(LB)])
    d = wide.join(m.where("n >= 3"), "obs")
    return round_all(d.select("obs", T.centroid([f"v_{b}" for b in LB], LOG_C, 0.01, log_widths()).alias("nu_c")))


@query("t25_state_index", f"""WITH {PAIR}, bw AS (SELECT obs, t - 600 AS start, t + 1200 AS stop FROM oe WHERE event_type = 'error' AND value > 250),
  cl AS (SELECT * FROM sgm WHERE NOT EXISTS (SELECT 1 FROM bw WHERE bw.obs = sgm.obs AND sgm.t0 < bw.stop AND sgm.t0 + 230400 > bw.start)),
  m AS (SELECT obs, count(*) AS n_rows, median(num_state / den) AS v FROM cl GROUP BY 1), f AS (SELECT obs, n_rows, CASE WHEN n_rows >= 3 THEN round({sroot('v')}, 6) END AS rms FROM m)
  SELECT *, CASE WHEN rms IS NULL THEN 'unknown' WHEN rms > 0.10 THEN 'hard-like' WHEN rms < 0.075 THEN 'soft-like' ELSE 'intermediate' END AS state FROM f""")
def t25(spark, sf):
    e = obs_events(spark, sf).where("event_type = 'error' and value > 250")
    bw = T.exclusion_windows(e, ["obs"], "t", "t", 600.0, 1200.0, "list")
    s = pair_segments(spark, sf).withColumn("t1_end", F.col("t0") + LEN)
    clean = I.outside(s, bw, ["obs"], "t0", "t1_end")
    m = T.median_variance(clean, ["obs"], ["state"]).select("obs", "n_rows", F.round("state", 6).alias("rms"))
    return m.withColumn("state", C.two_threshold_state("rms", 0.075, 0.10))


@query("t26_null_band_status", f"""WITH {PAIR}, {ratio_sql(['white'])} SELECT obs, n_seg, CASE WHEN n_seg >= 3 THEN round(r_white / nullif(e_white, 0), 5) END AS null_z,
  CASE WHEN n_seg < 3 THEN 'missing (< 3 valid segments)' WHEN abs(r_white / e_white) > 1.5 THEN 'excluded (null band |z| > 1.5)' ELSE 'ok' END AS status FROM mv""")
def t26(spark, sf):
    m = T.mean_variance(pair_segments(spark, sf), ["obs"], ["white"]).drop("status")
    return round_all(T.null_status(m, "white_var", "white_se", "n_seg", 3, 1.5).select("obs", "n_seg", "null_z", "status"), 5)


@query("t27_segment_colours", f"""WITH {PAIR}, g AS (SELECT e.obs, count(CASE WHEN k < 30 THEN 1 END) AS a, count(CASE WHEN k >= 30 AND k < 60 THEN 1 END) AS b, count(CASE WHEN k >= 60 AND k < 100 THEN 1 END) AS c
  FROM oe e JOIN sgm s ON e.obs = s.obs AND e.t >= s.t0 AND e.t < s.t0 + 230400e0 GROUP BY 1)
  SELECT obs, a, b, c, round(b / nullif(a, 0), 6) AS c1, round(c / nullif(b, 0), 6) AS c2 FROM g""".replace("round(b / nullif(a, 0)", "round(b::DOUBLE / nullif(a, 0)").replace("round(c / nullif(b, 0)", "round(c::DOUBLE / nullif(b, 0)"))
def t27(spark, sf):
    bands = {"a": (0, 30), "b": (30, 60), "c": (60, 100)}
    return round_all(T.segment_colours(obs_events(spark, sf), pair_segments(spark, sf), ["obs"], "t", "k", LEN, bands))


@query("t28_ratio_screen", f"""WITH {EVENTS}, g AS (SELECT user_id, count(CASE WHEN k >= 80 AND k < 100 THEN 1 END) AS n_high, count(CASE WHEN k >= 10 AND k < 60 THEN 1 END) AS n_low FROM ev GROUP BY 1),
  q AS (SELECT quantile_cont(n_high::DOUBLE / n_low, 0.9) AS lim FROM g WHERE n_low >= 5)
  SELECT user_id, n_high, n_low, round(n_high::DOUBLE / nullif(n_low, 0), 9) AS ratio, coalesce(n_high::DOUBLE / nullif(n_low, 0) > lim, false) AS flagged FROM g, q""")
def t28(spark, sf):
    return round_all(T.ratio_screen(events(spark, sf), ["user_id"], "k", (80, 100), (10, 60), 5, 0.9), 9)


HALF = ["t1", "t2", "state"]


@query("t29_split_half", f"""WITH {PAIR}, ix AS (SELECT *, ((row_number() OVER (PARTITION BY obs ORDER BY t0) - 1) % 2)::INTEGER AS half FROM sgm), {ratio_sql(HALF, 'ix', ', half')}
  SELECT obs, half, n_seg, {', '.join(f'round({sroot(f"r_{b}")}, 6) AS {b}' for b in HALF)} FROM mv""")
def t29(spark, sf):
    return round_all(T.halves(pair_segments(spark, sf), ["obs"], HALF).select("obs", "half", "n_seg", *HALF))


@query("t31_prefix_comparison", f"""WITH {PAIR}, ix AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY t0) AS i FROM sgm),
  f AS (SELECT obs, sum(num_state) / sum(den) AS full_v, sum(CASE WHEN i <= 5 THEN num_state END) / sum(CASE WHEN i <= 5 THEN den END) AS part_v FROM ix GROUP BY 1),
  g AS (SELECT obs, {sroot('full_v')} AS a, {sroot('part_v')} AS b FROM f), r AS (SELECT a, b, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM g)
  SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho, round(2 * corr(ra, rb) / (1 + corr(ra, rb)), 9) AS reliability,
  count(CASE WHEN (a > 0.1) <> (b > 0.1) OR (a < 0.075) <> (b < 0.075) THEN 1 END) AS n_changed FROM r""")
def t31(spark, sf):
    s = O.row_index(pair_segments(spark, sf), ["obs"], "t0", out="i")
    full = T.mean_variance(s, ["obs"], ["state"], 1).select("obs", F.col("state").alias("a"))
    part = T.mean_variance(s.where("i <= 5"), ["obs"], ["state"], 1).select("obs", F.col("state").alias("b"))
    j = J.join_unique(full, part, ["obs"])
    rho = O.spearman(j, [], "a", "b").withColumn("reliability", reliability("rho"))
    state = [C.two_threshold_state(c, 0.075, 0.10) for c in "ab"]
    changed = j.agg(F.count(F.when(state[0] != state[1], 1)).alias("n_changed"))
    return round_all(O.attach_row(rho, changed), 9)


WIDTHS = [0.25 * 2.0 ** i for i in range(9)]
LOR_EDGES = [(a - 0.5, b + 0.5) for a, b in LOG]


def lorentz_sql():
    long = " UNION ALL ".join(f"SELECT obs, {i} AS i, r_lb{i} AS y, e_lb{i} AS e, {lo!r}::DOUBLE AS lo, {hi!r}::DOUBLE AS hi FROM mv" for i, (lo, hi) in enumerate(LOR_EDGES))
    return f"""y0 AS ({long}), yy AS (SELECT * FROM y0 WHERE y IS NOT NULL AND e > 0),
  w AS (SELECT unnest(range(0, 9)) AS wi, 0.25e0 * pow(2e0, wi) AS d), m AS (SELECT obs, i, y, 1 / (e * e) AS w, wi, 2e0 / pi() * (atan(hi / d) - atan(lo / d)) AS s FROM yy, w),
  c AS (SELECT obs, a.wi AS i, b.wi AS k, sum(w * a.s * a.s) AS aa, sum(w * a.s * b.s) AS ab, sum(w * b.s * b.s) AS bb, sum(w * a.s * y) AS ay, sum(w * b.s * y) AS by_, sum(w * y * y) AS yy, count(*) AS n
  FROM m a JOIN (SELECT obs, i, wi, s FROM m) b USING (obs, i) WHERE a.wi <= b.wi GROUP BY ALL),
  f AS (SELECT *, CASE WHEN i = k THEN greatest(1e-8, ay / aa) ELSE (ay * bb - by_ * ab) / (aa * bb - ab * ab) END AS r1, CASE WHEN i = k THEN 0e0 ELSE (by_ * aa - ay * ab) / (aa * bb - ab * ab) END AS r2 FROM c WHERE n >= 6),
  g AS (SELECT *, yy - 2 * (r1 * ay + r2 * by_) + r1 * r1 * aa + r2 * r2 * bb + 2 * r1 * r2 * ab AS chi2 FROM f WHERE i = k OR (r1 > 1e-8 AND r2 > 1e-8)),
  h AS (SELECT *, row_number() OVER (PARTITION BY obs, i = k ORDER BY chi2, i, k) AS rn FROM g), o AS (SELECT * FROM h WHERE i = k AND rn = 1), t AS (SELECT * FROM h WHERE i <> k AND rn = 1),
  b AS (SELECT o.obs, o.n, o.chi2 + 2 * ln(o.n) AS bic1, t.chi2 + 4 * ln(o.n) AS bic2, o.i AS i1, t.i AS i2, o.r1 AS ra, t.r1 AS rb FROM o LEFT JOIN t USING (obs))
  SELECT obs, n::INTEGER AS n_bins, CASE WHEN bic1 - bic2 > 2 THEN 2 ELSE 1 END AS n_lor, round(bic1, 4) AS bic1, round(bic2, 4) AS bic2,
  0.25e0 * pow(2e0, CASE WHEN bic1 - bic2 > 2 THEN i2 ELSE i1 END) AS nu_l, round(sqrt(CASE WHEN bic1 - bic2 > 2 THEN rb ELSE ra END), 4) AS rms_l FROM b"""


@query("t32_lorentzian_fit", f"WITH {PAIR}, {ratio_sql(LB)}, {lorentz_sql()}")
def t32(spark, sf):
    m = T.mean_variance(pair_segments(spark, sf), ["obs"], LB, 1)
    fit = T.fit_lorentzians(m, ["obs"], [f"{b}_var" for b in LB], [f"{b}_se" for b in LB], LOR_EDGES, WIDTHS, d_bic=2.0)
    return round_all(fit, 4)


@query("t33_gain_shift", f"""WITH {VECTORS}, r AS (SELECT *, lead(rate) OVER (PARTITION BY vec_id ORDER BY bin) AS r2 FROM rvec),
  p AS (SELECT vec_id, max(CASE WHEN e_lo <= 6 AND e_hi > 6 THEN rate + (r2 - rate) * (6 - e_lo) / (e_hi - e_lo) END) AS a, max(CASE WHEN e_lo <= 20 AND e_hi > 20 THEN rate + (r2 - rate) * (20 - e_lo) / (e_hi - e_lo) END) AS b
  FROM r GROUP BY 1) SELECT vec_id, round(a / 0.11e0 - 1, 6) AS shift_low, round(b / 0.12e0 - 1, 6) AS shift_high, round(greatest(abs(a / 0.11e0 - 1), abs(b / 0.12e0 - 1)), 6) AS max_shift FROM p""")
def t33(spark, sf):
    grid = [lo for lo, _ in EDGES]
    v = vectors(spark, sf).select("vec_id", T.vector_at("rate", grid, 6.0).alias("a"), T.vector_at("rate", grid, 20.0).alias("b"))
    return round_all(T.gain_shift(v, {"low": "a", "high": "b"}, {"low": 0.11, "high": 0.12}).drop("a", "b"))


@query("t34_interval_rates", f"""WITH {OBSEV}, gw AS (SELECT obs, w * 604800e0 AS start, w * 604800e0 + 302400e0 AS stop FROM (SELECT DISTINCT obs FROM oe), (SELECT unnest(range(0, 5)) AS w)),
  bn AS (SELECT obs, det, floor(t / 1800e0) * 1800e0 + 900e0 AS tc, count(*) AS n FROM oe GROUP BY ALL), g AS (SELECT bn.* FROM bn JOIN gw ON gw.obs = bn.obs AND tc >= start AND tc < stop),
  cv AS (SELECT obs, count(DISTINCT tc) * 1800e0 AS covered FROM g GROUP BY 1) SELECT obs, det, max(covered) AS covered, round(sum(n) / max(covered), 9) AS rate FROM g JOIN cv USING (obs) GROUP BY 1, 2""")
def t34(spark, sf):
    e = obs_events(spark, sf)
    b = e.groupBy("obs", "det", (F.floor(F.col("t") / 1800.0) * 1800.0 + 900.0).alias("tc")).agg(F.count(F.lit(1)).alias("n"))
    w = e.select("obs").distinct().withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(4))))
    w = w.select("obs", (F.col("w") * 604800.0).alias("start"), (F.col("w") * 604800.0 + 302400.0).alias("stop"))
    return round_all(T.interval_rates(b, w, ["obs"], "tc", 1800.0, "det", "n"), 9)

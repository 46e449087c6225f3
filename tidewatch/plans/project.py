"""Filters, gates and row-level features on the given tables."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import joins as J
from tidewatch.operators import project as P
from tidewatch.plans.registry import query
from tidewatch.plans.views import EDGES, EVENTS, OBS, VECTORS, events, observations, round_all, rounded, sky, sky_sql, vectors
from tidewatch.sources.tables import table

BANDS = [(5.0, 7.0), (7.0, 10.0), (10.0, 16.0), (16.0, 25.1)]


@query("p1_eligibility_filter", f"""WITH {OBS} SELECT obs_id, source_id FROM obs WHERE rate >= 50000 AND mjd >= 50000 AND mjd < 51677
  AND CASE WHEN status = 'P' THEN NULL ELSE rate END <= 400000""")
def p1(spark, sf):
    # rules on the stored columns, so that they reach the Parquet scan; MJD 50000 and 51677 are these dates
    o = table(spark, sf, "orders")
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1995-10-10", "2000-05-13"))
    rate = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    rules = [F.col("o_totalprice") >= 50000.0, F.col("o_orderdate") >= first, F.col("o_orderdate") < last, rate <= 400000.0]
    return P.eligible(o, rules).select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("source_id"))


@query("p2_threshold_or_missing", f"""WITH {OBS}, o AS (SELECT obs_id, CASE WHEN status <> 'O' THEN rate END AS rate FROM obs)
  SELECT * FROM o WHERE rate >= 200000 OR rate IS NULL""")
def p2(spark, sf):
    o = observations(spark, sf).select("obs_id", F.when(F.col("status") != "O", F.col("rate")).alias("rate"))
    return P.at_least_or_missing(o, "rate", 200000.0)


@query("p3_quality_gate", f"""WITH {OBS}, r AS (SELECT obs_id, concat_ws(';', CASE WHEN NOT rate >= 100000 THEN 'rate' END,
  CASE WHEN NOT mjd >= 50500 THEN 'early' END, CASE WHEN NOT status <> 'P' THEN 'status' END) AS reason FROM obs)
  SELECT *, CASE WHEN reason = '' THEN 'accepted' ELSE 'excluded' END AS status FROM r""")
def p3(spark, sf):
    rules = {"rate": F.col("rate") >= 100000, "early": F.col("mjd") >= 50500, "status": F.col("status") != "P"}
    return P.quality_gate(observations(spark, sf), rules).select("obs_id", "reason", "status")


@query("p4_shape_vector", f"""WITH {VECTORS} SELECT vec_id, bin::INTEGER AS bin,
  round(rate / sum(rate) OVER (PARTITION BY vec_id), 9) AS share FROM rvec""")
def p4(spark, sf):
    d = vectors(spark, sf).select("vec_id", F.posexplode(C.shape("rate")).alias("bin", "share"))
    return d.select("vec_id", (F.col("bin") + 1).alias("bin"), F.round("share", 9).alias("share"))


@query("p5_asinh_vector", f"WITH {VECTORS} SELECT vec_id, bin::INTEGER AS bin, round(asinh(x / 0.1e0), 9) AS y FROM rvec")
def p5(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode(F.transform("x", lambda x: C.asinh_scaled(x, 0.1))).alias("bin", "y"))
    return v.select("vec_id", (F.col("bin") + 1).alias("bin"), F.round("y", 9).alias("y"))


def band_sql(value, alias, lo, hi):
    return f"sum(CASE WHEN sqrt(e_lo * e_hi) >= {lo}e0 AND sqrt(e_lo * e_hi) < {hi}e0 THEN {value} * (e_hi - e_lo) ELSE 0 END) AS {alias}"


FOUR = ", ".join(band_sql("rate", f"b{i + 1}", lo, hi) for i, (lo, hi) in enumerate(BANDS))


@query("p6_band_sum", f"WITH {VECTORS}, b AS (SELECT vec_id, {FOUR} FROM rvec GROUP BY 1) SELECT vec_id, round(b1, 6) AS b1, round(b4, 6) AS b4 FROM b")
def p6(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.round(P.band_sum("rate", EDGES, *BANDS[0]), 6).alias("b1"), F.round(P.band_sum("rate", EDGES, *BANDS[3]), 6).alias("b4"))


@query("p7_colour_ratios", f"""WITH {VECTORS}, b AS (SELECT vec_id, {FOUR} FROM rvec GROUP BY 1)
  SELECT vec_id, round(b2 / b1, 6) AS c1, round(b4 / b3, 6) AS c2, round(log10(b1 + b2 + b3 + b4), 6) AS log_total,
  b1 > 0 AND b3 > 0 AS positive_bands FROM b""")
def p7(spark, sf):
    return round_all(P.colours(vectors(spark, sf), "rate", EDGES, BANDS).select("vec_id", "c1", "c2", "log_total", "positive_bands"))


EXPECTED = ", ".join(band_sql("pow(1.02e0, -bin)", f"m{i + 1}", lo, hi) for i, (lo, hi) in enumerate(BANDS))


@query("p8_response_normalised", f"""WITH {VECTORS}, b AS (SELECT vec_id, {FOUR}, {EXPECTED},
  max(CASE WHEN bin = 9 THEN rate / pow(1.02e0, -bin) END) AS n9 FROM rvec GROUP BY 1)
  SELECT vec_id, round((b2 / m2) / (b1 / m1), 6) AS c1, round((b4 / m4) / (b3 / m3), 6) AS c2, round(n9, 6) AS n9 FROM b""")
def p8(spark, sf):
    v = vectors(spark, sf).withColumn("flat", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pow(F.lit(1.02), -i.cast("double"))))
    d = P.response_normalised(v, "rate", "flat", EDGES, BANDS)
    return round_all(d.select("vec_id", "c1", "c2", F.element_at("norm", 9).alias("n9")))


THREE = """pt AS (SELECT l_suppkey AS source_id, l_shipdate AS day, sum(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0 END) AS lo,
  sum(CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0 END) AS mid, sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0 END) AS hi
  FROM lineitem GROUP BY 1, 2)"""


def three_band(spark, sf):
    """One point per source and day with three band sums."""
    li = table(spark, sf, "lineitem")
    s = {b: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(b) for b, f in (("lo", "A"), ("mid", "N"), ("hi", "R"))}
    return li.groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("day")).agg(*s.values())


DAY = "(epoch_us(day) / 86400000000)::BIGINT"


@query("p9_normalised_difference", f"""WITH {THREE} SELECT source_id, {DAY} AS day, round((mid - lo) / nullif(mid + lo, 0), 6) AS c1,
  round((hi - mid) / nullif(hi + mid, 0), 6) AS c2 FROM pt""")
def p9(spark, sf):
    d = three_band(spark, sf)
    return round_all(d.select("source_id", F.unix_date(F.to_date("day")).cast("long").alias("day"),
                              C.normalised_difference("lo", "mid").alias("c1"), C.normalised_difference("mid", "hi").alias("c2")))


@query("p10_relative_intensity", f"""WITH {EVENTS} SELECT event_id, round(value / quantile_cont(value, 0.9999) OVER (PARTITION BY user_id), 6) AS intensity
  FROM ev""")
def p10(spark, sf):
    return round_all(P.relative_intensity(events(spark, sf), ["user_id"], "value").select("event_id", "intensity"))


@query("p11_signed_sqrt", f"WITH {VECTORS} SELECT vec_id, bin::INTEGER AS bin, round(sign(x) * sqrt(abs(x)), 9) AS y FROM vec")
def p11(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode("x").alias("bin", "x"))
    return v.select("vec_id", (F.col("bin") + 1).alias("bin"), F.round(C.signed_sqrt("x"), 9).alias("y"))


@query("p12_state_classes", """SELECT l_suppkey AS source_id, l_linenumber AS line, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS rms0,
  CASE WHEN rms0 IS NULL THEN 'unknown' WHEN rms0 > 0.0505e0 THEN 'hard-like' WHEN rms0 < 0.0495e0 THEN 'soft-like' ELSE 'intermediate' END AS state
  FROM lineitem GROUP BY 1, 2""".replace("avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS rms0,\n  CASE",
  "round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 6) AS rms,\n  CASE").replace("rms0", "rms"))
def p12(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("line")).agg(
        F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))), 6).alias("rms"))
    return g.withColumn("state", C.two_threshold_state("rms", 0.0495, 0.0505))


BREAKS = [50163.7729, 50188.9618, 51259.7340, 51677.0]


@query("p13_epoch_bins", f"""WITH {OBS} SELECT obs_id, (CASE WHEN mjd >= 50163.7729 THEN 1 ELSE 0 END + CASE WHEN mjd >= 50188.9618 THEN 1 ELSE 0 END
  + CASE WHEN mjd >= 51259.7340 THEN 1 ELSE 0 END + CASE WHEN mjd >= 51677 THEN 1 ELSE 0 END)::INTEGER AS epoch FROM obs""")
def p13(spark, sf):
    return observations(spark, sf).select("obs_id", C.step_bin("mjd", BREAKS).alias("epoch"))


@query("p14_clip_and_log", f"WITH {OBS} SELECT obs_id, round(log10(greatest(2e4, least(4.5e5, rate))), 9) AS log_rate FROM obs")
def p14(spark, sf):
    return observations(spark, sf).select("obs_id", F.round(F.log10(C.clip("rate", 2e4, 4.5e5)), 9).alias("log_rate"))


@query("p15_epoch_key", f"WITH {EVENTS} SELECT event_id, concat_ws('_', user_id, printf('%.1f', t / 86400e0)) AS epoch_key FROM ev")
def p15(spark, sf):
    return events(spark, sf).select("event_id", P.epoch_key("user_id", F.col("t") / 86400.0).alias("epoch_key"))


@query("p16_mode_rule", """SELECT p_partkey, regexp_matches(p_brand, '^Brand#(1[0-9]|2[0-2])$') AND contains(p_name, 're')
  AND p_size / 64e0 <= 0.5e0 + 1e-12 AND list_contains(string_split(p_name, ' '), 'widget') AS qualifies FROM part""")
def p16(spark, sf):
    p = table(spark, sf, "part").withColumns({"words": F.split("p_name", " "), "step": F.col("p_size") / 64.0})
    ok = P.mode_qualifies("p_brand", "^Brand#(1[0-9]|2[0-2])$", "p_name", "re", "step", 0.5, "words", "widget")
    return p.select("p_partkey", ok.alias("qualifies"))


@query("p17_listing_names", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS name FROM pages""")
def p17(spark, sf):
    return P.extract_all(table(spark, sf, "pages"), "html", 'href="([^"]+)"', "name").select("page_id", "name")


LISTING = """li AS (SELECT p_partkey, concat(p_size, '.5', CASE p_partkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'G' ELSE '' END) AS size_text FROM part)"""


@query("p17_listing_sizes", f"""WITH {LISTING} SELECT p_partkey, size_text, regexp_extract(size_text, '^([0-9.]+)', 1)::DOUBLE
  * CASE right(size_text, 1) WHEN 'K' THEN 1024e0 WHEN 'M' THEN 1048576e0 WHEN 'G' THEN 1073741824e0 ELSE 1e0 END AS bytes FROM li""")
def p17b(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("K", "M", "G", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit).alias("size_text"))
    return d.withColumn("bytes", P.size_bytes("size_text"))


@query("p17_name_positions", f"""WITH {sky_sql('customer')}, n AS (SELECT id, printf('J%02d%02d.%d%s%02d%02d', floor(ra / 15)::INTEGER,
  floor((ra * 4) % 60)::INTEGER, floor((ra * 40) % 10)::INTEGER, CASE WHEN dec < 0 THEN '-' ELSE '+' END, floor(abs(dec))::INTEGER,
  floor((abs(dec) * 60) % 60)::INTEGER) AS name FROM customer_sky)
  SELECT id, name, round(15e0 * (substr(name, 2, 2)::DOUBLE + substr(name, 4, 4)::DOUBLE / 60e0), 9) AS ra,
  round(CASE WHEN substr(name, 8, 1) = '-' THEN -1e0 ELSE 1e0 END * (substr(name, 9, 2)::DOUBLE + substr(name, 11, 2)::DOUBLE / 60e0), 9) AS dec FROM n""")
def p17c(spark, sf):
    c = sky(spark, sf, "customer")
    parts = [F.floor(F.col("ra") / 15), F.floor((F.col("ra") * 4) % 60), F.floor((F.col("ra") * 40) % 10),
             F.when(F.col("dec") < 0, "-").otherwise("+"), F.floor(F.abs("dec")), F.floor((F.abs("dec") * 60) % 60)]
    n = c.select("id", F.format_string("J%02d%02d.%d%s%02d%02d", *parts).alias("name"))
    ra, dec = P.jname_position("name")
    return n.select("id", "name", F.round(ra, 9).alias("ra"), F.round(dec, 9).alias("dec"))


@query("p18_month_keys", """SELECT o_orderkey AS obs_id, s.shift, strftime(o_orderdate::DATE + s.shift, '%Y_%m') AS month_key
  FROM orders, (SELECT unnest([0, -31, 31])::INTEGER AS shift) s""")
def p18(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), F.to_date("o_orderdate").alias("day"))
    return P.month_paths(o, "day").select("obs_id", "shift", "month_key")


@query("p19_category_map", f"""WITH {OBS} SELECT obs_id, CASE priority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'a' WHEN '3-MEDIUM' THEN 'b'
  WHEN '5-LOW' THEN 'c' ELSE 'other' END AS cls FROM obs""")
def p19(spark, sf):
    m = {"1-URGENT": "a", "2-HIGH": "a", "3-MEDIUM": "b", "5-LOW": "c"}
    return observations(spark, sf).select("obs_id", P.map_category("priority", m, "other").alias("cls"))


@query("p20_overlap_box", f"""WITH {VECTORS}, b AS (SELECT vec_id, {FOUR} FROM rvec GROUP BY 1)
  SELECT vec_id, b2 / b1 BETWEEN 1.2e0 AND 1.6e0 AND b4 / b3 BETWEEN 1.4e0 AND 1.9e0 AS in_box FROM b""")
def p20(spark, sf):
    d = P.colours(vectors(spark, sf), "rate", EDGES, BANDS)
    return d.select("vec_id", P.in_box("c1", "c2", (1.2, 1.6), (1.4, 1.9)).alias("in_box"))


@query("p21_dead_time", f"""WITH {EVENTS}, r AS (SELECT user_id, det, count(*) / 10e0 AS xe FROM ev GROUP BY 1, 2),
  x AS (SELECT user_id, count(CASE WHEN value < 20 OR value > 50 THEN 1 END) * 1e0 AS other, count(CASE WHEN value > 100 THEN 1 END) * 1e0 AS large,
  CASE WHEN user_id % 2 = 0 THEN '01' ELSE '234' END AS sel FROM ev GROUP BY 1),
  g AS (SELECT user_id, count(CASE WHEN xe > 1 THEN 1 END) AS n_on, avg(CASE WHEN contains(sel, det::VARCHAR) THEN xe END) AS xe, first(other) AS o, first(large) AS l
  FROM r JOIN x USING (user_id) GROUP BY 1), f AS (SELECT user_id, n_on, 1e-5 * xe + (1e-5 * o + 6e-5 * l) / nullif(n_on, 0) AS f FROM g)
  SELECT user_id, n_on, round(f, 9) AS fraction, round(1 / (1 - f), 9) AS correction FROM f""")
def p21(spark, sf):
    e = events(spark, sf)
    r = e.groupBy("user_id", "det").agg((F.count(F.lit(1)) / 10.0).alias("xe"))
    x = e.groupBy("user_id").agg(F.count(F.when((F.col("value") < 20) | (F.col("value") > 50), 1)).cast("double").alias("other"),
                                 F.count(F.when(F.col("value") > 100, 1)).cast("double").alias("large"))
    x = x.withColumn("sel", F.when(F.col("user_id") % 2 == 0, "01").otherwise("234"))
    return round_all(P.dead_time(r.join(x, "user_id"), ["user_id"], "det", "xe", "other", "large", "sel"), 9)


@query("p22_net_spectrum", """WITH s AS (SELECT l_suppkey AS source_id, l_linenumber AS channel, l_returnflag AS f, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2, 3),
  a AS (SELECT *, 1000e0 + source_id AS t, 1e0 + source_id % 3 AS area FROM s WHERE f = 'A'),
  b AS (SELECT *, 2000e0 + source_id AS t, 2e0 + source_id % 5 AS area FROM s WHERE f = 'N')
  SELECT source_id, channel, round(1.1e0 * (a.n / (a.t * a.area) - a.area / b.area * b.n / (b.t * a.area)), 9) AS net,
  round(1.1e0 * sqrt(a.n / pow(a.t * a.area, 2) + pow(a.area / b.area, 2) * b.n / pow(b.t * a.area, 2)), 9) AS err
  FROM a JOIN b USING (source_id, channel)""")
def p22(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("channel"), "l_returnflag").agg(
        F.sum("l_quantity").alias("counts"))

    def side(flag, t0, a0, m):
        return g.where(F.col("l_returnflag") == flag).select("source_id", "channel", "counts", (F.col("source_id") + F.lit(float(t0))).alias("time"),
                                                             (F.col("source_id") % m + F.lit(float(a0))).alias("area"))

    d = P.net_spectrum(side("A", 1000, 1, 3).withColumn("k", F.lit(1.1)), side("N", 2000, 2, 5), ["source_id", "channel"], "k")
    return round_all(d.select("source_id", "channel", "net", "err"), 9)


BKG = """b AS (SELECT l_suppkey AS source_id, sum(CASE WHEN l_linenumber <= 2 THEN l_quantity END) AS a, sum(CASE WHEN l_linenumber BETWEEN 3 AND 4 THEN l_quantity END) AS b,
  sum(CASE WHEN l_linenumber > 4 THEN l_quantity END) AS c, stddev_pop(l_quantity) / avg(l_quantity) / 8 AS rms FROM lineitem GROUP BY 1),
  fr AS (SELECT l_suppkey AS source_id, avg(CASE WHEN l_linenumber <= 2 THEN l_discount END) AS fa, avg(CASE WHEN l_linenumber BETWEEN 3 AND 4 THEN l_discount END) AS fb,
  avg(CASE WHEN l_linenumber > 4 THEN l_discount END) AS fc, avg(l_discount) AS ft FROM lineitem WHERE l_suppkey % 7 <> 3 GROUP BY 1)"""


@query("p23_background_correction", f"""WITH {BKG}, j AS (SELECT source_id, a * (1 - coalesce(fa, 0)) AS a, b * (1 - coalesce(fb, 0)) AS b,
  c * (1 - coalesce(fc, 0)) AS c, rms / (1 - coalesce(ft, 0)) AS rms FROM b LEFT JOIN fr USING (source_id) WHERE coalesce(ft, 0) <= 0.0505)
  SELECT source_id, round(b / a, 6) AS c1, round(c / b, 6) AS c2, round(rms, 6) AS rms,
  CASE WHEN round(rms, 6) > 0.075e0 THEN 'hard-like' WHEN round(rms, 6) < 0.0745e0 THEN 'soft-like' ELSE 'intermediate' END AS state FROM j""")
def p23(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "source_id")
    n = F.col("l_linenumber")
    band = {"a": n <= 2, "b": n.between(3, 4), "c": n > 4}
    b = li.groupBy("source_id").agg(*[F.sum(F.when(c, F.col("l_quantity"))).alias(k) for k, c in band.items()],
                                    (F.stddev_pop("l_quantity") / F.avg("l_quantity") / 8).alias("rms"))
    fr = li.where("source_id % 7 <> 3").groupBy("source_id").agg(*[F.avg(F.when(c, F.col("l_discount"))).alias(f"f{k}") for k, c in band.items()],
                                                                 F.avg("l_discount").alias("ft"))
    d = P.background_corrected(b, fr, "source_id", {k: f"f{k}" for k in band}, ["rms"], "ft", 0.0505)
    d = d.select("source_id", rounded(C.ratio("b", "a"), 6).alias("c1"), rounded(C.ratio("c", "b"), 6).alias("c2"), rounded(F.col("rms"), 6).alias("rms"))
    return d.withColumn("state", C.two_threshold_state("rms", 0.0745, 0.075))


def transmission(spark):
    """Monotone attenuation grid by column depth, three bands."""
    nh = F.col("id") * 0.05
    return spark.range(201).select(nh.alias("depth"), F.exp(-1.2 * nh).alias("t_lo"), F.exp(-0.5 * nh).alias("t_mid"), F.exp(-0.1 * nh).alias("t_hi"))


GRID = """grid AS (SELECT i * 0.05e0 AS depth, exp(-1.2e0 * depth) AS t_lo, exp(-0.5e0 * depth) AS t_mid, exp(-0.1e0 * depth) AS t_hi
  FROM (SELECT unnest(range(0, 201))::DOUBLE AS i)), g2 AS (SELECT *, lead(depth) OVER (ORDER BY depth) AS d2, lead(t_lo) OVER (ORDER BY depth) AS lo2,
  lead(t_mid) OVER (ORDER BY depth) AS mid2, lead(t_hi) OVER (ORDER BY depth) AS hi2 FROM grid)"""


@query("p24_attenuation_correction", f"""WITH {THREE}, {GRID}, p AS (SELECT *, (source_id % 97) * 0.1037e0 AS nh FROM pt),
  m AS (SELECT p.*, least(nh, 10e0) AS q FROM p)
  SELECT source_id, {DAY} AS day, round(lo / (t_lo + (lo2 - t_lo) * (q - depth) / (d2 - depth)), 4) AS lo,
  round(mid / (t_mid + (mid2 - t_mid) * (q - depth) / (d2 - depth)), 4) AS mid, round(hi / (t_hi + (hi2 - t_hi) * (q - depth) / (d2 - depth)), 4) AS hi
  FROM m JOIN g2 ON q >= depth AND (q < d2 OR (q = 10 AND d2 >= 10 - 1e-9 AND depth < 10 - 1e-9))""")
def p24(spark, sf):
    d = three_band(spark, sf).withColumn("nh", (F.col("source_id") % 97) * 0.1037)
    d = J.interp_join(d, "nh", transmission(spark), "depth", ["t_lo", "t_mid", "t_hi"])
    return d.select("source_id", F.unix_date(F.to_date("day")).cast("long").alias("day"),
                    *[F.round(C.ratio(b, f"t_{b}"), 4).alias(b) for b in ("lo", "mid", "hi")])


@query("p25_time_convert", f"""WITH {OBS}, l AS (SELECT unnest([49534, 50083, 50630, 51179, 53736, 54832, 56109, 57204, 57754]) AS since),
  n AS (SELECT obs_id, mjd, 32.184e0 + 28 + (SELECT count(*) FROM l WHERE since <= mjd) AS off FROM obs)
  SELECT obs_id, round((mjd - 49353e0) * 86400e0, 3) AS met, round(off, 3) AS offset_s, round((mjd - off / 86400e0 - 49353e0) * 86400e0, 3) AS utc_met FROM n""")
def p25(spark, sf):
    o = observations(spark, sf)
    return round_all(o.select("obs_id", P.mission_seconds("mjd", 49353.0).alias("met"), P.tt_minus_utc("mjd").alias("offset_s"),
                              P.mission_seconds(P.utc_from_tt("mjd"), 49353.0).alias("utc_met")), 3)

"""Joins on the given tables."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import joins as J
from tidewatch.plans.registry import query
from tidewatch.plans.views import EVENTS, OBS, SCORES, VECTORS, events, observations, round_all, scores, sep_sql, sky, sky_sql, vectors
from tidewatch.sources.tables import table


@query("j1_validated_join", f"WITH {OBS} SELECT obs_id, source_id, rate, c_mktsegment AS segment FROM obs JOIN customer ON c_custkey = source_id")
def j1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("segment"))
    return J.join_unique(observations(spark, sf).select("obs_id", "source_id", "rate"), c, ["source_id"])


@query("j2_lookup_default", """SELECT d.doc_id, d.lang, coalesce(CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, 'unlabelled') AS label
  FROM documents d LEFT JOIN (SELECT * FROM labels) l USING (doc_id)""".replace("coalesce(CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, 'unlabelled')",
  "CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 1 THEN 'good' ELSE 'bad' END"))
def j2(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return J.lookup(table(spark, sf, "documents").select("doc_id", "lang"), lab, ["doc_id"], {"label": "unlabelled"})


@query("j3_reindex", """SELECT c_custkey AS source_id, n, t FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def j3(spark, sf):
    g = observations(spark, sf).where("status = 'P'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate"), 2).alias("t"))
    return J.reindex(g, table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id")), ["source_id"])


@query("j4_key_sets", f"""WITH {OBS} SELECT obs_id, source_id FROM obs WHERE source_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  AND source_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def j4(spark, sf):
    o = observations(spark, sf).select("obs_id", "source_id")
    good = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"))
    bad = events(spark, sf).where("event_type = 'error'").select(F.col("user_id").alias("source_id"))
    return J.without_keys(J.only_keys(o, good, ["source_id"]), bad, ["source_id"])


@query("j5_flag_merge", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, EXISTS (SELECT 1 FROM lineitem b
  WHERE b.l_suppkey = a.l_suppkey AND b.l_shipdate = a.l_shipdate AND b.l_returnflag = 'R' AND b.l_tax > 0.07) AS flagged FROM lineitem a""")
def j5(spark, sf):
    li = table(spark, sf, "lineitem")
    hit = li.where("l_returnflag = 'R' and l_tax > 0.07").select("l_suppkey", "l_shipdate")
    return J.flag_join(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"), hit, ["l_suppkey", "l_shipdate"], "flagged").drop("l_shipdate")


@query("j6_angular_separation", f"""WITH {sky_sql('customer')}, s AS (SELECT *, (ra + 1.5e0) % 360e0 AS ra2, greatest(dec - 0.5e0, -90e0) AS dec2 FROM customer_sky)
  SELECT a.id, round({sep_sql('a', 'b')}, 8) AS sep FROM customer_sky a JOIN (SELECT id, ra2 AS ra, dec2 AS dec FROM s) b USING (id)""")
def j6(spark, sf):
    c = sky(spark, sf, "customer").withColumns({"ra2": (F.col("ra") + 1.5) % 360.0, "dec2": F.greatest(F.col("dec") - 0.5, F.lit(-90.0))})
    return c.select("id", F.round(C.sep_deg("ra", "dec", "ra2", "dec2"), 8).alias("sep"))


SKIES = f"{sky_sql('customer')}, {sky_sql('supplier')}"


@query("j7_cone_search", f"""WITH {SKIES} SELECT a.id AS source_id, b.id AS obs_id, round({sep_sql('a', 'b')}, 6) AS sep
  FROM supplier_sky a, customer_sky b WHERE {sep_sql('a', 'b')} <= 2.5""")
def j7(spark, sf):
    j = J.cone_join(sky(spark, sf, "supplier"), sky(spark, sf, "customer"), 2.5)
    return j.select(F.col("l_id").alias("source_id"), F.col("r_id").alias("obs_id"), F.round("sep", 6).alias("sep"))


@query("j8_nearest_match", f"""WITH {SKIES}, m AS (SELECT a.id AS source_id, b.id AS match_id, {sep_sql('a', 'b')} AS sep,
  0.8e0 + (a.id % 3) * 0.8e0 AS tol FROM customer_sky a, supplier_sky b), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sep, match_id) AS rn
  FROM m WHERE sep <= tol) SELECT source_id, match_id, round(sep, 6) AS sep FROM r WHERE rn = 1""")
def j8(spark, sf):
    left = sky(spark, sf, "customer").withColumn("tol", F.lit(0.8) + (F.col("id") % 3) * 0.8)
    m = J.nearest(left, sky(spark, sf, "supplier"), 2.4, "tol")
    return m.select(F.col("l_id").alias("source_id"), F.col("r_id").alias("match_id"), F.round("sep", 6).alias("sep"))


@query("j9_confused_sources", f"""WITH {sky_sql('customer')} SELECT a.id, count(CASE WHEN a.id <> b.id AND {sep_sql('a', 'b')} <= 1.5 THEN 1 END) AS n_near
  FROM customer_sky a, customer_sky b GROUP BY 1""")
def j9(spark, sf):
    return J.neighbour_counts(sky(spark, sf, "customer"), 1.5).select("id", "n_near")


@query("j9_ambiguous_matches", f"""WITH {SKIES}, m AS (SELECT a.id AS source_id, b.id, b.ra, b.dec, b.positive FROM supplier_sky a, customer_sky b
  WHERE {sep_sql('a', 'b')} <= 5), c AS (SELECT source_id, count(*) AS n, count(DISTINCT positive) AS n_cls FROM m GROUP BY 1),
  x AS (SELECT a.source_id, max(CASE WHEN a.id < b.id THEN {sep_sql('a', 'b')} END) AS extent FROM m a JOIN m b USING (source_id) GROUP BY 1)
  SELECT source_id, n, n_cls, round(coalesce(extent, 0), 5) AS extent, n_cls > 1 OR coalesce(extent, 0) > 6 AS rejected FROM c JOIN x USING (source_id)""")
def j9b(spark, sf):
    m = J.cone_join(sky(spark, sf, "supplier"), sky(spark, sf, "customer"), 5.0).withColumnRenamed("l_id", "source_id")
    return round_all(J.ambiguous(m, "source_id", "r_positive", "r_ra", "r_dec", 6.0, "r_id", centre=("l_ra", "l_dec", "sep")), 5)


@query("j10_interpolation", f"""WITH {EVENTS}, g AS (SELECT (i * i)::DOUBLE AS gx, ln(1e0 + i) AS gy FROM (SELECT unnest(range(0, 20)) AS i)),
  h AS (SELECT gx, gy, lead(gx) OVER (ORDER BY gx) AS gx2, lead(gy) OVER (ORDER BY gx) AS gy2 FROM g)
  SELECT event_id, round(coalesce(gy + (gy2 - gy) * (value - gx) / (gx2 - gx), (SELECT max(gy) FROM g)), 9) AS y
  FROM ev LEFT JOIN h ON value >= gx AND value < gx2""")
def j10(spark, sf):
    i = F.col("id")
    grid = spark.range(20).select((i * i).cast("double").alias("gx"), F.log(1.0 + i).alias("y"))
    return round_all(J.interp_join(events(spark, sf), "value", grid, "gx", ["y"]).select("event_id", "y"), 9)


CHANNELS = """ch AS (SELECT vec_id, bin, rate, 0.1e0 * sqrt(rate) AS err, 3e0 + (bin - 1) * 0.35e0 AS lo, 3e0 + bin * 0.35e0 AS hi FROM rvec)"""


@query("j15_fractional_rebin", f"""WITH {VECTORS}, {CHANNELS}, b AS (SELECT unnest(range(0, 10))::INTEGER AS bin, 4e0 + bin * 1.5e0 AS a, 5.5e0 + bin * 1.5e0 AS b)
  SELECT vec_id, b.bin, round(sum((least(hi, b) - greatest(lo, a)) / (hi - lo) * rate), 6) AS rate,
  round(sqrt(sum(pow((least(hi, b) - greatest(lo, a)) / (hi - lo) * err, 2))), 6) AS err FROM ch JOIN b ON a < hi AND b > lo GROUP BY 1, 2""")
def j15(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode("rate").alias("i", "rate"))
    v = v.withColumns({"lo": 3.0 + F.col("i") * 0.35, "hi": 3.0 + (F.col("i") + 1) * 0.35, "err": 0.1 * F.sqrt("rate")})
    return round_all(J.fractional_rebin(v, ["vec_id"], "lo", "hi", "rate", "err", [4.0 + 1.5 * i for i in range(11)]))


RESPONSE = """resp AS (SELECT e AS bin, c AS channel, exp(-abs(e - 2 * c) / 2e0) AS value FROM (SELECT unnest(range(1, 65)) AS e), (SELECT unnest(range(1, 33)) AS c)
  WHERE abs(e - 2 * c) <= 6)"""


def response(spark):
    """Sparse response by a rule: each energy bin leaks into channels near half its number."""
    d = spark.range(1, 65).select(F.col("id").alias("bin"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(32).cast("long"))).alias("channel"))
    gap = F.abs(F.col("bin") - 2 * F.col("channel"))
    return d.where(gap <= 6).withColumn("value", F.exp(-gap / 2.0))


@query("j16_fold_response", f"""WITH {VECTORS}, {RESPONSE} SELECT vec_id, channel, round(sum(rate * value), 6) AS folded
  FROM rvec JOIN resp USING (bin) GROUP BY 1, 2""")
def j16(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode("rate").alias("bin", "rate")).withColumn("bin", F.col("bin").cast("long") + 1)
    return round_all(J.fold_response(v, response(spark), ["vec_id"], "bin", "channel", "value", "rate"))


@query("j17_compare_runs", f"""WITH {SCORES}, a AS (SELECT source_id, stratum, avg(score_a) AS s FROM oof WHERE source_id % 10 <> 1 GROUP BY 1, 2),
  b AS (SELECT source_id, stratum, avg(score_b) AS s FROM oof WHERE source_id % 10 <> 2 GROUP BY 1, 2),
  j AS (SELECT a.s AS sa, b.s AS sb, a.s >= 0.505 AS la, b.s >= 0.505 AS lb FROM a FULL JOIN b USING (source_id, stratum))
  SELECT round(max(abs(sa - sb)), 9) AS max_abs_diff, sum(CASE WHEN la <> lb THEN 1 ELSE 0 END)::BIGINT AS label_changes,
  sum(CASE WHEN sb IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_first, sum(CASE WHEN sa IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_second, false AS passed FROM j""")
def j17(spark, sf):
    s = scores(spark, sf)

    def run(c, skip):
        g = s.where(F.col("source_id") % 10 != skip).groupBy("source_id", "stratum").agg(F.avg(c).alias("s"))
        return g.withColumn("label", F.col("s") >= 0.505)

    return round_all(J.compare_runs(run("score_a", 1), run("score_b", 2), ["source_id", "stratum"], "s", "label", 1e-9), 9)


@query("j18_identity_map", f"""WITH {SKIES}, m AS (SELECT a.id, b.id AS match_id, a.id % 5 = 0 AS la, b.id % 3 = 0 AS lb, {sep_sql('a', 'b')} AS sep FROM customer_sky a, supplier_sky b),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sep, match_id) AS rn FROM m WHERE sep <= 2)
  SELECT c.id, coalesce('b' || match_id, 'a' || c.id) AS canonical, coalesce(la <> lb, false) AS conflict, round(sep, 6) AS sep
  FROM customer_sky c LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (id)""")
def j18(spark, sf):
    a = sky(spark, sf, "customer").withColumnRenamed("positive", "label")
    b = sky(spark, sf, "supplier").withColumn("label", F.col("id") % 3 == 0).drop("positive")
    return J.canonical_ids(a, b, 2.0).select("id", "canonical", "conflict", F.round("sep", 6).alias("sep"))

"""Grouped summaries on the given tables."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import aggregate as A
from tidewatch.operators import ordered as O
from tidewatch.plans.registry import query
from tidewatch.plans.views import EVENTS, OBS, SCORES, VECTORS, events, observations, round_all, scores, sky, sky_sql, vectors
from tidewatch.sources.tables import table


@query("a1_attrition_funnel", f"""WITH {OBS} SELECT source_id, count(*) AS n_all, sum(CASE WHEN rate >= 50000 THEN 1 ELSE 0 END)::BIGINT AS bright,
  sum(CASE WHEN rate >= 50000 AND mjd < 51677 THEN 1 ELSE 0 END)::BIGINT AS early,
  sum(CASE WHEN rate >= 50000 AND mjd < 51677 AND status <> 'P' THEN 1 ELSE 0 END)::BIGINT AS final FROM obs GROUP BY 1""")
def a1(spark, sf):
    rules = {"bright": F.col("rate") >= 50000, "early": F.col("mjd") < 51677, "final": F.col("status") != "P"}
    return A.attrition(observations(spark, sf), ["source_id"], rules)


@query("a2_group_summary", f"""WITH {OBS} SELECT source_id, count(rate) AS n, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median,
  max(c_mktsegment) AS segment, count(DISTINCT status) AS n_distinct FROM obs JOIN customer ON c_custkey = source_id GROUP BY 1""")
def a2(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("segment"))
    return round_all(A.group_summary(observations(spark, sf).join(c, "source_id"), ["source_id"], "rate", "segment", "status"), 6)


@query("a3_percentile_band", """SELECT l_suppkey AS source_id, round(quantile_cont(l_extendedprice, 0.025), 6) AS p2_5, round(quantile_cont(l_extendedprice, 0.16), 6) AS p16,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.84), 6) AS p84, round(quantile_cont(l_extendedprice, 0.975), 6) AS p97_5
  FROM lineitem GROUP BY 1""")
def a3(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), "l_extendedprice")
    return round_all(O.percentiles(li, ["source_id"], "l_extendedprice", {"p2_5": 0.025, "p16": 0.16, "p50": 0.5, "p84": 0.84, "p97_5": 0.975}), 6)


@query("a4_value_shares", """SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM documents GROUP BY 1, 2""")
def a4(spark, sf):
    return round_all(A.value_shares(table(spark, sf, "documents"), ["source"], "lang"), 9)


@query("a5_agreement_table", """SELECT sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS n11, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS n10,
  sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS n01, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS n00,
  round(avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END), 9) AS agreement FROM labels""")
def a5(spark, sf):
    return round_all(A.agreement(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1), 9)


@query("a5_crosstab", """SELECT d.lang, count(CASE WHEN quality = 0 THEN 1 END) AS "0", count(CASE WHEN quality = 1 THEN 1 END) AS "1"
  FROM documents d JOIN labels USING (doc_id) GROUP BY 1""")
def a5b(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return A.crosstab(d, "lang", "quality", [0, 1])


BINS = f"""{OBS}, binned AS (SELECT *, ntile(8) OVER (PARTITION BY source_id ORDER BY mjd, obs_id) AS bin FROM obs)"""


@query("a6_empty_bins", f"""WITH {BINS}, c AS (SELECT source_id, bin, max(CASE WHEN rate > 250000 THEN 1 ELSE 0 END) AS f FROM binned GROUP BY 1, 2)
  SELECT source_id, count(*) AS n_bins, sum(f)::BIGINT AS n_filled, (count(*) - sum(f))::BIGINT AS n_empty FROM c GROUP BY 1""")
def a6(spark, sf):
    b = O.equal_count_bins(observations(spark, sf), ["source_id"], "mjd", ["obs_id"], k=8)
    return A.empty_bins(b, b.where("rate > 250000"), "source_id", "bin")


@query("a7_describe", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1""")
def a7(spark, sf):
    return round_all(A.describe(table(spark, sf, "events"), ["event_type"], "value"))


@query("a8_pivot_wide", """WITH g AS (SELECT l_suppkey AS source_id, l_returnflag AS f, avg(l_discount) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  SELECT source_id, round(max(CASE WHEN f = 'A' THEN d END), 9) AS d_A, round(max(CASE WHEN f = 'A' THEN q END), 9) AS q_A, round(max(CASE WHEN f = 'N' THEN d END), 9) AS d_N,
  round(max(CASE WHEN f = 'N' THEN q END), 9) AS q_N, round(max(CASE WHEN f = 'R' THEN d END), 9) AS d_R, round(max(CASE WHEN f = 'R' THEN q END), 9) AS q_R FROM g GROUP BY 1""")
def a8(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("f")).agg(
        F.avg("l_discount").alias("disc"), F.sum("l_quantity").alias("qty"))
    return round_all(A.wide(g, ["source_id"], "f", ["A", "N", "R"], {"disc": "d", "qty": "q"}), 9)


@query("a9_median_rows", """SELECT l_suppkey AS source_id, l_linenumber AS band, round(median(l_tax * l_quantity), 9) AS median FROM lineitem GROUP BY 1, 2""")
def a9(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("band"), (F.col("l_tax") * F.col("l_quantity")).alias("v"))
    return round_all(O.percentiles(li, ["source_id", "band"], "v", {"median": 0.5}), 9)


@query("a10_split_half", f"""WITH {OBS}, h AS (SELECT source_id, avg(CASE WHEN obs_id % 2 = 1 THEN rate END) AS odd, avg(CASE WHEN obs_id % 2 = 0 THEN rate END) AS even FROM obs GROUP BY 1)
  SELECT source_id % 5 AS grp, round(median(abs(odd - even) / 2), 4) AS half_difference FROM h WHERE odd IS NOT NULL AND even IS NOT NULL GROUP BY 1""")
def a10(spark, sf):
    h = A.split_half(observations(spark, sf), ["source_id"], "rate", F.col("obs_id"))
    return round_all(A.half_difference(h.withColumn("grp", F.col("source_id") % 5), ["grp"]), 4)


@query("a11_standardise", """SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type), 6) AS value_z FROM events""")
def a11(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return round_all(A.standardise(e, ["event_type"], ["value"]).select("event_id", "value_z"))


RATIO = """WITH g AS (SELECT l_suppkey AS source_id, l_extendedprice * l_discount AS x, l_extendedprice AS d FROM lineitem),
  r AS (SELECT source_id, count(*) AS n, sum(x) / sum(d) AS ratio FROM g GROUP BY 1)"""


@query("a12_ratio_of_sums", f"""{RATIO} SELECT source_id, r.n, round(r.ratio, 9) AS ratio, round(sqrt(sum(pow(x - ratio * d, 2)) * n / (n - 1)) / sum(d), 9) AS ratio_se
  FROM g JOIN r USING (source_id) GROUP BY source_id, r.n, r.ratio""")
def a12(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_extendedprice") * F.col("l_discount")).alias("x"), F.col("l_extendedprice").alias("d"))
    return round_all(A.ratio_of_sums(li, ["source_id"], "x", "d"), 9)


@query("a13_mean_of_ratios", """SELECT l_suppkey AS source_id, count(l_tax / nullif(l_discount, 0)) AS n, round(avg(l_tax / nullif(l_discount, 0)), 9) AS ratio,
  round(stddev_samp(l_tax / nullif(l_discount, 0)) / sqrt(count(l_tax / nullif(l_discount, 0))), 9) AS ratio_se FROM lineitem GROUP BY 1""")
def a13(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "source_id")
    return round_all(A.mean_of_ratios(li, ["source_id"], "l_tax", "l_discount"), 9)


@query("a14_weighted_mean", """WITH g AS (SELECT user_id, value - 48 AS x, 5 + event_id % 7 AS s FROM events), m AS (SELECT user_id, count(*) AS n, sum(x / (s * s)) / sum(1e0 / (s * s)) AS m,
  1 / sqrt(sum(1e0 / (s * s))) AS se FROM g GROUP BY 1) SELECT user_id, n, round(m, 6) AS mean, round(se, 6) AS se, round(m / se, 6) AS z,
  round(greatest(m, 0) + 3 * se, 6) AS upper_limit, m / se > 3 AS detected FROM m""")
def a14(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("value") - 48).alias("x"), (F.col("event_id") % 7 + 5).cast("double").alias("s"))
    return round_all(A.inverse_variance_mean(e, ["user_id"], "x", "s"))


@query("a15_null_band", """WITH g AS (SELECT l_suppkey AS source_id, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS x, stddev_samp(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS ex,
  avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS b, stddev_samp(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS eb FROM lineitem GROUP BY 1)
  SELECT source_id, round(x - 2.5e0 * b, 6) AS x_net, round(sqrt(ex * ex + 6.25e0 * eb * eb), 6) AS x_net_se FROM g""")
def a15(spark, sf):
    def stats(flag, c, name):
        v = F.when(F.col("l_returnflag") == flag, F.col(c))
        return [F.avg(v).alias(name), F.stddev_samp(v).alias(f"e{name}")]

    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(*stats("A", "l_quantity", "x"), *stats("N", "l_discount", "b"))
    return round_all(A.minus_null_band(g, "x", "ex", "b", "eb", 5.0, 2.0).select("source_id", "x_net", "x_net_se"))


@query("a16_main_mode", """WITH g AS (SELECT user_id, event_type, sum(value) AS total FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, event_type) AS rn FROM g)
  SELECT user_id, event_type, round(total, 6) AS total FROM r WHERE rn = 1""")
def a16(spark, sf):
    return round_all(A.main_mode(table(spark, sf, "events"), "user_id", "event_type", "value"))


@query("a17_weighted_plane", """WITH p AS (SELECT l_returnflag AS cls, l_quantity AS y, l_discount AS a, l_tax * 10 AS b, 1e0 + l_linenumber AS w FROM lineitem),
  s AS (SELECT cls, count(*) AS n, sum(w) AS s0, sum(w*a) AS sa, sum(w*b) AS sb, sum(w*a*a) AS saa, sum(w*a*b) AS sab, sum(w*b*b) AS sbb, sum(w*y) AS sy, sum(w*a*y) AS say, sum(w*b*y) AS sby, sum(w*y*y) AS syy FROM p GROUP BY 1),
  e AS (SELECT *, saa - sa*sa/s0 AS ca, sbb - sb*sb/s0 AS cb, sab - sa*sb/s0 AS cab, say - sa*sy/s0 AS cy, sby - sb*sy/s0 AS dy FROM s),
  f AS (SELECT *, (cy*cb - dy*cab)/(ca*cb - cab*cab) AS b1, (dy*ca - cy*cab)/(ca*cb - cab*cab) AS b2 FROM e), h AS (SELECT *, (sy - b1*sa - b2*sb)/s0 AS b0 FROM f),
  v AS (SELECT cls, sum(w * pow(y - b0 - b1*a - b2*b, 2)) / sum(w) AS var FROM p JOIN h USING (cls) GROUP BY 1)
  SELECT cls, n, round(b0, 4) AS beta0, round(b1, 4) AS beta1, round(b2, 4) AS beta2, round(sqrt(var), 4) AS sigma FROM h JOIN v USING (cls)""")
def a17(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("a"),
                                            (F.col("l_tax") * 10).alias("b"), (F.col("l_linenumber") + 1.0).alias("w"))
    return round_all(A.weighted_plane(p, ["cls"], "y", "a", "b", "w"), 4)


@query("a18_class_moments", """SELECT l_returnflag AS cls, count(*) AS n, round(avg(l_discount), 9) AS mx, round(avg(l_tax), 9) AS my, round(var_samp(l_discount), 9) AS cxx,
  round(covar_samp(l_discount, l_tax), 9) AS cxy, round(var_samp(l_tax), 9) AS cyy FROM lineitem GROUP BY 1""")
def a18(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "cls")
    return round_all(A.moments(li, ["cls"], "l_discount", "l_tax"), 9)


@query("a19_integrity_report", """SELECT 'unique ids' AS "check", CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END AS result FROM orders
  UNION ALL SELECT 'positive rates', CASE WHEN min(o_totalprice) > 0 THEN 'PASS' ELSE 'FAIL' END FROM orders
  UNION ALL SELECT 'known sources', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'unique lines', CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'PASS' ELSE 'FAIL' END FROM lineitem""")
def a19(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return A.check_report({
        "unique ids": (o.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")), F.max("n") == 1),
        "positive rates": (o, F.min("o_totalprice") > 0),
        "known sources": (o.join(c, "o_custkey", "left_anti"), F.count(F.lit(1)) == 0),
        "unique lines": (li, F.max("n") == 1)})


@query("a20_median_vector", f"""WITH {VECTORS}, m AS (SELECT bin, median(rate) AS med FROM rvec GROUP BY 1)
  SELECT vec_id, round(avg(abs((rate - med) / med)), 6) AS deviation FROM rvec JOIN m USING (bin) GROUP BY 1""")
def a20(spark, sf):
    return round_all(A.relative_deviation(vectors(spark, sf), "vec_id", "rate"))


@query("a20_tilt", f"""WITH {VECTORS}, q AS (SELECT vec_id, label, max(CASE WHEN bin = 50 THEN rate END) / max(CASE WHEN bin = 10 THEN rate END) AS q FROM rvec GROUP BY 1, 2)
  SELECT label, round(median(q), 6) AS tilt FROM q GROUP BY 1""")
def a20b(spark, sf):
    return round_all(A.tilt(vectors(spark, sf), "label", "rate", 10, 50))


@query("a21_accuracy_range", f"""WITH {SCORES}, s AS (SELECT source_id, stratum, avg(CASE WHEN (score_b >= 0.5) = positive THEN 1e0 ELSE 0e0 END) AS acc FROM oof GROUP BY 1, 2),
  l AS (SELECT stratum, acc, (sum(acc) OVER (PARTITION BY stratum) - acc) / (count(*) OVER (PARTITION BY stratum) - 1) AS rest FROM s)
  SELECT stratum, count(*) AS n_sources, round(avg(acc), 9) AS mean_accuracy, round(min(rest), 9) AS low, round(max(rest), 9) AS high FROM l GROUP BY 1""")
def a21(spark, sf):
    s = scores(spark, sf).groupBy("source_id", "stratum").agg(F.avg(((F.col("score_b") >= 0.5) == F.col("positive")).cast("double")).alias("acc"))
    return round_all(A.accuracy_range(s, ["stratum"], "acc"), 9)


@query("a22_covariates_by_outcome", f"""WITH {SCORES} SELECT stratum, (score_b >= 0.5) = positive AS correct, count(*) AS n, round(median(score_a), 9) AS median FROM oof GROUP BY 1, 2""")
def a22(spark, sf):
    s = scores(spark, sf).withColumn("correct", (F.col("score_b") >= 0.5) == F.col("positive"))
    n = s.groupBy("stratum", "correct").agg(F.count(F.lit(1)).alias("n"))
    return round_all(n.join(O.percentiles(s, ["stratum", "correct"], "score_a", {"median": 0.5}), ["stratum", "correct"]), 9)


@query("a23_tertile_strata", """WITH c AS (SELECT quantile_cont(o_totalprice, 1e0/3) AS a, quantile_cont(o_totalprice, 2e0/3) AS b FROM orders)
  SELECT o_orderkey AS obs_id, CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'mid' ELSE 'high' END AS stratum FROM orders, c""")
def a23(spark, sf):
    o = observations(spark, sf)
    return o.select("obs_id", A.tertile_label("rate", A.tertile_cuts(o, "rate")).alias("stratum"))


@query("a24_grouping_sets", """SELECT l_returnflag AS stratum, l_linestatus AS status, count(*) AS n, round(avg(l_discount), 9) AS mean, count(DISTINCT l_suppkey) AS n_sources
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def a24(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("stratum"), F.col("l_linestatus").alias("status"), "l_discount", "l_suppkey")
    fine = li.groupBy("stratum", "status", "l_suppkey").agg(F.count(F.lit(1)).alias("c"), F.sum("l_discount").alias("d"))
    sets = [[F.col("stratum"), F.col("status")], [F.col("stratum")], []]
    g = fine.groupingSets(sets, "stratum", "status").agg(F.sum("c").alias("n"), (F.sum("d") / F.sum("c")).alias("mean"), F.countDistinct("l_suppkey").alias("n_sources"))
    return round_all(g, 9)


@query("a25_median_pointing", f"""WITH {sky_sql('customer')}, c AS (SELECT id % 25 AS source_id, CASE WHEN id % 11 <> 0 THEN ra END AS ra, dec FROM customer_sky)
  SELECT source_id, count(*) AS n_rows, round(median(ra), 6) AS ra, round(median(dec), 6) AS dec FROM c GROUP BY 1""")
def a25(spark, sf):
    c = sky(spark, sf, "customer").select((F.col("id") % 25).alias("source_id"), F.when(F.col("id") % 11 != 0, F.col("ra")).alias("ra"), "dec")
    n = c.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return round_all(n.join(O.percentiles(c, ["source_id"], "ra", {"ra": 0.5}), "source_id").join(O.percentiles(c, ["source_id"], "dec", {"dec": 0.5}), "source_id"))


@query("a26_band_rates", f"""WITH {EVENTS}, s AS (SELECT user_id, k, sum(value) AS counts, 100e0 + user_id AS exposure, CASE WHEN user_id % 2 = 0 THEN sum(value) / 50e0 END AS rate FROM ev GROUP BY 1, 2),
  b AS (SELECT user_id, sum(CASE WHEN k >= 0 AND k < 30 THEN coalesce(rate, counts / exposure) END) AS a, sum(CASE WHEN k >= 30 AND k < 60 THEN coalesce(rate, counts / exposure) END) AS b,
  sum(CASE WHEN k >= 0 AND k < 100 THEN coalesce(rate, counts / exposure) END) AS t FROM s GROUP BY 1)
  SELECT user_id, round(a, 6) AS a, round(b, 6) AS b, round(t, 6) AS t, round(b / nullif(CASE WHEN t > 0 THEN t END, 0), 6) AS f_b FROM b""")
def a26(spark, sf):
    s = events(spark, sf).groupBy("user_id", "k").agg(F.sum("value").alias("counts"))
    s = s.withColumns({"exposure": 100.0 + F.col("user_id"), "rate": F.when(F.col("user_id") % 2 == 0, F.col("counts") / 50.0)})
    b = A.band_rates(s, ["user_id"], "k", {"a": (0, 30), "b": (30, 60), "t": (0, 100)})
    return round_all(b.withColumn("f_b", F.when(F.col("t") > 0, C.ratio("b", "t"))))

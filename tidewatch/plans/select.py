"""Selection, sampling, ranking and set operations on the given tables."""

from pyspark.sql import functions as F

from tidewatch.operators import joins as J
from tidewatch.operators import ordered as O
from tidewatch.operators import select as S
from tidewatch.plans.project import DAY, THREE, three_band
from tidewatch.plans.registry import query
from tidewatch.plans.views import EVENTS, OBS, SCORES, VECTORS, events, observations, round_all, scores, vectors
from tidewatch.sources.tables import table

BINS = f"""{OBS}, binned AS (SELECT *, ntile(5) OVER (PARTITION BY source_id ORDER BY mjd, obs_id)::INTEGER AS bin FROM obs),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, bin ORDER BY md5(concat_ws(':', 42, obs_id)), obs_id)::INTEGER AS rank FROM binned)"""


def candidates(spark, sf, k=5):
    return S.stratified_candidates(observations(spark, sf), "source_id", "mjd", "obs_id", k, 42)


@query("w1_first_wins", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def w1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return S.first_wins(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("w2_time_bins", f"WITH {OBS} SELECT obs_id, ntile(15) OVER (PARTITION BY source_id ORDER BY mjd, obs_id)::INTEGER AS bin FROM obs")
def w2(spark, sf):
    return O.equal_count_bins(observations(spark, sf), ["source_id"], "mjd", ["obs_id"], k=15).select("obs_id", "bin")


@query("w3_random_rank", f"WITH {BINS} SELECT obs_id, bin, rank FROM ranked")
def w3(spark, sf):
    return candidates(spark, sf).select("obs_id", "bin", "rank")


@query("w4_first_acceptable", f"""WITH {BINS}, b AS (SELECT source_id, bin, min(rank) AS best FROM ranked WHERE rank <= 3 AND rate > 300000 GROUP BY 1, 2)
  SELECT obs_id, rank, coalesce(rank = best, false) AS accepted FROM ranked LEFT JOIN b USING (source_id, bin) WHERE rank <= 3 AND rank <= coalesce(best, 3)""")
def w4(spark, sf):
    return S.first_acceptable(candidates(spark, sf), ["source_id", "bin"], "rank", F.col("rate") > 300000, 3).select("obs_id", "rank", "accepted")


@query("w5_replacements", f"""WITH {OBS.replace('o_custkey', 'o_custkey // 10')}, binned AS (SELECT *, ntile(5) OVER (PARTITION BY source_id ORDER BY mjd, obs_id)::INTEGER AS bin FROM obs),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, bin ORDER BY md5(concat_ws(':', 42, obs_id)), obs_id)::INTEGER AS rank FROM binned),
  a AS (SELECT source_id, bin, min(rank) AS old_rank FROM ranked WHERE rate > 250000 GROUP BY 1, 2),
  n AS (SELECT r.*, old_rank, row_number() OVER (PARTITION BY r.source_id, r.bin ORDER BY rank) AS i, rate > 250000 AS good, status = 'F' AS clean FROM ranked r JOIN a USING (source_id, bin) WHERE rank > old_rank),
  l AS (SELECT a.*, coalesce(max(i), 0) AS n FROM a LEFT JOIN n USING (source_id, bin) GROUP BY ALL),
  p1 AS (SELECT l.source_id, l.bin, l.old_rank, n, min(CASE WHEN good AND i <= 6 THEN i END) AS p, coalesce(min(CASE WHEN good AND i <= 6 THEN i END), 6) AS e FROM l LEFT JOIN n USING (source_id, bin) GROUP BY ALL),
  p2 AS (SELECT p1.*, min(CASE WHEN good AND i > e AND i <= e + 6 THEN i END) AS q, coalesce(min(CASE WHEN good AND i > e AND i <= e + 6 THEN i END), any_value(e) + 6) AS f FROM p1 LEFT JOIN n USING (source_id, bin) GROUP BY ALL),
  p3 AS (SELECT p2.*, min(CASE WHEN good AND i > f AND i <= f + 6 THEN i END) AS r, coalesce(min(CASE WHEN good AND i > f AND i <= f + 6 THEN i END), any_value(f) + 6) AS g FROM p2 LEFT JOIN n USING (source_id, bin) GROUP BY ALL),
  c AS (SELECT p3.*, (SELECT rank FROM n x WHERE x.source_id = p3.source_id AND x.bin = p3.bin AND x.i = p AND clean) AS r1, (SELECT rank FROM n x WHERE x.source_id = p3.source_id AND x.bin = p3.bin AND x.i = q AND clean) AS r2,
    (SELECT rank FROM n x WHERE x.source_id = p3.source_id AND x.bin = p3.bin AND x.i = r AND clean) AS r3 FROM p3)
  SELECT source_id, bin, old_rank, coalesce(r1, r2, r3) AS new_rank, CASE WHEN coalesce(r1, r2, r3) IS NOT NULL THEN 'replaced' WHEN n <= e OR n <= f OR n < g THEN 'no candidate' ELSE 'not clean' END AS status FROM c""")
def w5(spark, sf):
    o = observations(spark, sf).withColumn("source_id", F.floor(F.col("source_id") / 10))
    c = S.stratified_candidates(o, "source_id", "mjd", "obs_id", 5, 42)
    good = F.col("rate") > 250000
    acc = c.where(good).groupBy("source_id", "bin").agg(F.min("rank").alias("rank"))
    return S.replacements(acc, c, ["source_id", "bin"], "rank", good, F.col("status") == "F")


@query("w6_running_index", f"WITH {OBS} SELECT obs_id, (row_number() OVER (PARTITION BY source_id ORDER BY mjd, obs_id) - 1)::BIGINT AS idx FROM obs")
def w6(spark, sf):
    d = O.row_index(observations(spark, sf), ["source_id"], "mjd", ["obs_id"], out="idx")
    return d.select("obs_id", (F.col("idx") - 1).alias("idx"))


@query("w7_capped_sample", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', 7, event_id)), event_id) AS rn FROM events) WHERE rn <= 20""")
def w7(spark, sf):
    return S.capped(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], 20, "event_id", 7).select("event_id")


SEQ = """pos AS (SELECT source_id, obs_id, row_number() OVER (PARTITION BY source_id ORDER BY obs_id) - 1 AS idx, count(*) OVER (PARTITION BY source_id) AS n FROM oof),
  sq AS (SELECT draw, source_id, i, ('0x' || substr(md5(concat_ws(':', 11, draw, source_id, i)), 1, 15))::BIGINT % n AS idx FROM
  (SELECT DISTINCT source_id, n FROM pos), (SELECT unnest(range(0, 20)) AS draw), (SELECT unnest(range(0, 248)) AS i)),
  f AS (SELECT draw, source_id, idx, min(i) AS i FROM sq GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY draw, source_id ORDER BY i) AS rn FROM f)"""


@query("w8_sample_k", f"""WITH {SCORES}, {SEQ} SELECT draw::INTEGER AS draw, k::INTEGER AS k, source_id, idx FROM g, (SELECT unnest([1, 5, 21]) AS k) WHERE rn <= k""")
def w8(spark, sf):
    s = O.row_index(scores(spark, sf).select("source_id", "obs_id").withColumn("_o", F.xxhash64("obs_id").cast("double")), ["source_id"], "_o", ["obs_id"], out="idx", total="n")
    s = s.withColumn("idx", F.col("idx") - 1)
    return S.sample_k(s, "source_id", "idx", "n", 20, [1, 5, 21], 11)


@query("w9_average_rank", f"""WITH {SCORES}, v AS (SELECT stratum, score_b, count(*) AS c FROM oof GROUP BY 1, 2)
  SELECT stratum, round(score_b, 9) AS score, c AS n_ties, sum(c) OVER (PARTITION BY stratum ORDER BY score_b)::BIGINT - (c - 1) / 2e0 AS rank FROM v""")
def w9(spark, sf):
    r = O.average_ranks(scores(spark, sf), ["stratum"], "score_b")
    return r.select("stratum", F.round("_v", 9).alias("score"), F.col("_w").alias("n_ties"), "rank")


RANKS = """r AS (SELECT stratum, score_a, score_b, rank() OVER (PARTITION BY stratum ORDER BY score_a) + (count(*) OVER (PARTITION BY stratum, score_a) - 1) / 2e0 AS ra,
  rank() OVER (PARTITION BY stratum ORDER BY score_b) + (count(*) OVER (PARTITION BY stratum, score_b) - 1) / 2e0 AS rb FROM oof)"""


@query("w10_spearman", f"WITH {SCORES}, {RANKS} SELECT stratum, count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r GROUP BY 1")
def w10(spark, sf):
    return round_all(O.spearman(scores(spark, sf), ["stratum"], "score_a", "score_b"), 9)


@query("w11_reliability", f"""WITH {OBS}, h AS (SELECT source_id, source_id % 4 AS grp, avg(CASE WHEN obs_id % 2 = 1 THEN rate END) AS odd, avg(CASE WHEN obs_id % 2 = 0 THEN rate END) AS even FROM obs GROUP BY 1),
  k AS (SELECT * FROM h WHERE odd IS NOT NULL AND even IS NOT NULL), r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY odd) AS a, rank() OVER (PARTITION BY grp ORDER BY even) AS b FROM k),
  c AS (SELECT grp, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1) SELECT grp, n, round(rho, 9) AS rho, round(2 * rho / (1 + rho), 9) AS reliability FROM c""")
def w11(spark, sf):
    from tidewatch.operators.aggregate import split_half

    # means of amounts in cents: equal ones tie whatever the last bits that the order of their sums left
    h = round_all(split_half(observations(spark, sf), ["source_id"], "rate", F.col("obs_id")), 6).withColumn("grp", F.col("source_id") % 4)
    return round_all(O.spearman(h, ["grp"], "odd", "even").withColumn("reliability", S.reliability("rho")), 9)


@query("w12_largest_change", """WITH g AS (SELECT l_suppkey AS source_id, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) - avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS change FROM lineitem GROUP BY 1)
  SELECT source_id, round(change, 9) AS change FROM g ORDER BY abs(change) DESC, source_id LIMIT 10""")
def w12(spark, sf):
    def mean(f):
        return F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount")))

    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg((mean("A") - mean("R")).alias("change"))
    return round_all(g.orderBy(F.abs("change").desc(), "source_id").limit(10), 9)


@query("w13_holm", """WITH p AS (SELECT l_returnflag AS family, l_suppkey AS test, (sum(l_linenumber) % 1000) / 20000e0 AS p FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS rn, count(*) OVER (PARTITION BY family) AS m FROM p)
  SELECT family, test, round(max(least(1, (m - rn + 1) * p)) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM r""")
def w13(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("test")).agg(
        ((F.sum("l_linenumber") % 1000) / 20000.0).alias("p"))
    return round_all(S.holm(p, ["family"], "test", "p").select("family", "test", "p_adjusted"), 9)


@query("w14_clean_series", f"""WITH {THREE}, s AS (SELECT *, 10e0 + day_n % 5 AS e FROM (SELECT *, {DAY} AS day_n FROM pt)), d AS (SELECT * FROM s WHERE lo / e > 0.5 AND mid / e > 0.5),
  m AS (SELECT *, avg(lo) OVER w AS ml, stddev_samp(lo) OVER w AS sl, avg(mid) OVER w AS mm, stddev_samp(mid) OVER w AS sm FROM d WINDOW w AS (PARTITION BY source_id)),
  k AS (SELECT * FROM m WHERE lo <= ml + 1.5 * coalesce(sl, 0) AND mid <= mm + 1.5 * coalesce(sm, 0)), c AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM k)
  SELECT source_id, day_n AS day FROM c WHERE n >= 6""")
def w14(spark, sf):
    d = three_band(spark, sf).select("source_id", F.unix_date(F.to_date("day")).cast("long").alias("day"), "lo", "mid")
    d = d.withColumn("e", 10.0 + F.col("day") % 5)
    return S.clean_series(d, "source_id", {"lo": "e", "mid": "e"}, 1.5, 0.5, 6).select("source_id", "day")


@query("w15_report_order", """WITH b AS (SELECT n_regionkey AS block, n_name AS name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2),
  u AS (SELECT block, name, n, 1 AS body FROM b UNION ALL SELECT r_regionkey, r_name, NULL, 0 FROM region)
  SELECT block, name, n, (row_number() OVER (PARTITION BY block ORDER BY body, n DESC, name))::INTEGER AS line FROM u""")
def w15(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = s.groupBy(F.col("n_regionkey").alias("block"), F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    head = table(spark, sf, "region").select(F.col("r_regionkey").alias("block"), F.col("r_name").alias("name"))
    return S.report_order(b, "block", [F.col("n").desc(), F.col("name")], head)


@query("w16_score_margin", """WITH g AS (SELECT l_suppkey AS source_id, l_returnflag AS cls, avg(l_discount) AS p, stddev_samp(l_discount) / sqrt(count(*)) AS sd FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY p DESC, cls) AS rn FROM g)
  SELECT source_id, max(CASE WHEN rn = 1 THEN cls END) AS cls, round(max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END), 9) AS lead,
  max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END) < sum(CASE WHEN rn <= 2 THEN sd END) AS indeterminate FROM r GROUP BY 1""")
def w16(spark, sf):
    li = table(spark, sf, "lineitem")

    def stats(f):
        v = F.when(F.col("l_returnflag") == f, F.col("l_discount"))
        return [F.avg(v).alias(f"p{f}"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"s{f}")]

    g = li.groupBy(F.col("l_suppkey").alias("source_id")).agg(*[x for f in "ANR" for x in stats(f)])
    m = S.margin(g, {f: f"p{f}" for f in "ANR"}, {f: f"s{f}" for f in "ANR"})
    return round_all(m.select("source_id", "cls", "lead", "indeterminate"), 9)


@query("s1_union_by_name", """SELECT c_custkey AS source_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def s1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("s2_exclusion_union", """WITH a AS (SELECT DISTINCT user_id AS source_id FROM events WHERE value > 150), b AS (SELECT DISTINCT o_custkey AS source_id FROM orders WHERE o_totalprice > 490000)
  SELECT source_id, source_id IN (SELECT source_id FROM a) AS in_events, source_id IN (SELECT source_id FROM b) AS in_orders FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def s2(spark, sf):
    a = table(spark, sf, "events").where("value > 150").select(F.col("user_id").alias("source_id"))
    b = table(spark, sf, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("source_id"))
    u = a.withColumn("src", F.lit("e")).unionByName(b.withColumn("src", F.lit("o")))
    return u.groupBy("source_id").agg(F.max(F.col("src") == "e").alias("in_events"), F.max(F.col("src") == "o").alias("in_orders"))


@query("s3_common_keys", "SELECT user_id AS source_id FROM events INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def s3(spark, sf):
    a = table(spark, sf, "events").select(F.col("user_id").alias("source_id"))
    return a.intersect(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("source_id")))


@query("s4_disjointness", """SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_left_only,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)) AS n_shared, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)) = 0 AS disjoint""")
def s4(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), F.lit(1).alias("o")).distinct()
    e = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.lit(1).alias("e")).distinct()
    g = c.distinct().join(o, "source_id", "left").join(e, "source_id", "left").agg(F.count(F.when(F.col("o").isNull(), 1)).alias("n_left_only"), F.count("e").alias("n_shared"))
    return g.withColumn("disjoint", F.col("n_shared") == 0)


@query("s5_coverage_equality", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), b AS (SELECT s_suppkey AS k FROM supplier)
  SELECT count(CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 END) AS n_different, count(CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 END) = 0 AS equal FROM a FULL JOIN b USING (k)""")
def s5(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("b", F.lit(1))
    g = a.join(b, "k", "full_outer").agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("n_different"))
    return g.withColumn("equal", F.col("n_different") == 0)

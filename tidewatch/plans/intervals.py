"""Interval algebra on event sessions, weekly windows and padded exclusion windows."""

from pyspark.sql import functions as F

from tidewatch.operators import intervals as I
from tidewatch.plans.registry import query
from tidewatch.plans.views import EVENTS, events, round_all, sep_sql, sky, sky_sql

GAP = 43200.0
SEG = 14400.0

SESS = EVENTS + """, lagged AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS cut FROM ev),
  grouped AS (SELECT user_id, t, sum(cut) OVER (PARTITION BY user_id ORDER BY t) AS g FROM lagged),
  sess AS (SELECT user_id, min(t) AS start, max(t) AS stop FROM grouped WHERE user_id IN (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) > 1) GROUP BY user_id, g)"""


def sessions(spark, sf):
    return I.good_intervals(events(spark, sf), ["user_id"], "t", GAP)


def bursts(spark, sf):
    """Exclusion windows around error events."""
    e = events(spark, sf).where("event_type = 'error'")
    return e.select("user_id", "event_id", (F.col("t") - 600.0).alias("start"), (F.col("t") + 7200.0).alias("stop"))


BURSTS = "bst AS (SELECT user_id, event_id, t - 600 AS start, t + 7200 AS stop FROM ev WHERE event_type = 'error')"


def weeks(spark, sf):
    """Half-weekly windows per user."""
    u = events(spark, sf).select("user_id").distinct()
    w = u.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(4))))
    start = F.col("w") * 604800.0 + (F.col("user_id") % 7) * 3600.0
    return w.select("user_id", start.alias("start"), (start + 302400.0).alias("stop"))


WEEKS = """wk AS (SELECT user_id, w * 604800e0 + (user_id % 7) * 3600e0 AS start, w * 604800e0 + (user_id % 7) * 3600e0 + 302400e0 AS stop
  FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range(0, 5)) AS w))"""


def long_intervals(spark, sf):
    e = events(spark, sf)
    return e.select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 400.0).alias("stop"))


LONG = "itv AS (SELECT user_id, t AS start, t + value * 400 AS stop FROM ev)"


@query("j11_interval_overlap", f"""WITH {SESS}, {BURSTS} SELECT event_id, round(sess.start, 6) AS gti_start, round(sess.stop, 6) AS gti_stop FROM bst JOIN sess
  ON bst.user_id = sess.user_id AND bst.start <= sess.stop AND bst.stop >= sess.start""")
def j11(spark, sf):
    j = I.overlap_join(bursts(spark, sf), sessions(spark, sf), ["user_id"], closed=True)
    return round_all(j.select("event_id", F.col("b_start").alias("gti_start"), F.col("b_stop").alias("gti_stop")))


@query("j11_overlap_flag", f"""WITH {SESS}, {BURSTS}, {WEEKS} SELECT event_id, EXISTS (SELECT 1 FROM wk WHERE bst.user_id = wk.user_id AND bst.start <= wk.stop
  AND bst.stop >= wk.start) AS hit FROM bst""")
def j11b(spark, sf):
    return I.overlapping(bursts(spark, sf), weeks(spark, sf), ["user_id"]).select("event_id", "hit")


@query("j12_overlap_with_origin", f"""WITH {SESS}, {BURSTS}, {sky_sql('customer')}, a AS (SELECT bst.*, user_id % 7 AS grp, user_id AS id FROM bst),
  b AS (SELECT sess.*, user_id % 7 AS grp, user_id AS id FROM sess),
  p AS (SELECT a.event_id, a.user_id = b.user_id AS same_id, {sep_sql('x', 'y')} AS sep FROM a JOIN b ON a.grp = b.grp AND a.start <= b.stop AND a.stop >= b.start
  JOIN customer_sky x ON x.id = a.user_id JOIN customer_sky y ON y.id = b.user_id)
  SELECT event_id, count(*) AS n_any, count(CASE WHEN same_id THEN 1 END) AS n_same, count(CASE WHEN same_id OR sep <= 25 THEN 1 END) AS n_in_view FROM p GROUP BY 1""")
def j12(spark, sf):
    a = bursts(spark, sf).withColumn("grp", F.col("user_id") % 7)
    b = sessions(spark, sf).withColumn("grp", F.col("user_id") % 7)
    c = sky(spark, sf, "customer")
    pos = c.select(F.col("id").alias("user_id"), "ra", "dec")
    return I.overlap_counts(a.join(pos, "user_id"), b.join(pos, "user_id"), ["grp"], "event_id", "user_id", 25.0)


@query("j13_point_in_interval", f"""WITH {EVENTS}, {WEEKS} SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM wk WHERE wk.user_id = ev.user_id
  AND wk.start <= ev.t AND ev.t < wk.stop)""")
def j13(spark, sf):
    return I.inside(events(spark, sf), weeks(spark, sf), ["user_id"], "t").select("event_id")


SEGS = """seg AS (SELECT user_id, start + i * 14400e0 AS t0, start + i * 14400e0 + 14400e0 AS t1 FROM (SELECT user_id, start, unnest(range(0,
  floor((stop - start) / 14400e0)::BIGINT)) AS i FROM sess))"""
REMOVED = """rem AS (SELECT seg.*, EXISTS (SELECT 1 FROM bst WHERE bst.user_id = seg.user_id AND seg.t0 < bst.stop AND seg.t1 > bst.start) AS removed FROM seg)"""


@query("j14_interval_anti_join", f"""WITH {SESS}, {BURSTS}, {SEGS}, {REMOVED} SELECT user_id, round(t0, 6) AS t0 FROM rem WHERE NOT removed""")
def j14(spark, sf):
    s = I.segments(sessions(spark, sf), SEG)
    return round_all(I.outside(s, bursts(spark, sf), ["user_id"], "t0", "t1").select("user_id", "t0"))


@query("t1_interval_intersection", f"""WITH {SESS}, {WEEKS} SELECT s.user_id, round(greatest(s.start, w.start), 6) AS start, round(least(s.stop, w.stop), 6) AS stop
  FROM sess s JOIN wk w ON s.user_id = w.user_id AND greatest(s.start, w.start) < least(s.stop, w.stop)""")
def t1(spark, sf):
    return round_all(I.intersect(sessions(spark, sf), weeks(spark, sf), ["user_id"]))


@query("t2_interval_union", f"""WITH {EVENTS}, {LONG}, m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM itv), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start) AS isl FROM m)
  SELECT user_id, round(min(start), 6) AS start, round(max(stop), 6) AS stop FROM g GROUP BY user_id, isl""")
def t2(spark, sf):
    return round_all(I.merge(long_intervals(spark, sf), ["user_id"]))


SETS = """st AS (SELECT user_id % 10 AS key, user_id // 10 AS part, 0 AS set_id, start, stop FROM sess
  UNION ALL SELECT user_id % 10, user_id // 10, 1, start, stop FROM wk
  UNION ALL SELECT user_id % 10, user_id // 10, 2, w * 259200e0, w * 259200e0 + 216000e0 FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range(0, 10)) AS w))"""


@query("t3_common_good_time", f"""WITH {SESS}, {WEEKS}, {SETS}, abc AS (SELECT a.key, greatest(a.start, b.start, c.start) AS start, least(a.stop, b.stop, c.stop) AS stop
  FROM st a JOIN st b ON a.key = b.key AND a.part = b.part AND b.set_id = 1 AND a.start < b.stop AND b.start < a.stop
  JOIN st c ON a.key = c.key AND a.part = c.part AND c.set_id = 2 AND a.start < c.stop AND c.start < a.stop WHERE a.set_id = 0),
  itv AS (SELECT key, start, max(stop) AS stop FROM abc WHERE stop > start GROUP BY 1, 2),
  m AS (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM itv),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start ROWS UNBOUNDED PRECEDING) AS isl FROM m)
  SELECT key, round(min(start), 6) AS start, round(max(stop), 6) AS stop FROM g GROUP BY key, isl""")
def t3(spark, sf):
    def tag(df, i):
        return df.select((F.col("user_id") % 10).alias("key"), F.floor(F.col("user_id") / 10).alias("part"), F.lit(i).alias("set_id"), "start", "stop")

    third = weeks(spark, sf).select("user_id").distinct().withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(9))))
    third = third.select("user_id", (F.col("w") * 259200.0).alias("start"), (F.col("w") * 259200.0 + 216000.0).alias("stop"))
    sets = tag(sessions(spark, sf), 0).unionByName(tag(weeks(spark, sf), 1)).unionByName(tag(third, 2))
    return round_all(I.common_time(sets, "key", "part", "set_id"))


@query("t4_good_intervals", f"WITH {SESS} SELECT user_id, round(start, 6) AS start, round(stop, 6) AS stop FROM sess")
def t4(spark, sf):
    return round_all(sessions(spark, sf))


@query("t5_segment_capacity", f"""WITH {SESS} SELECT user_id, round(sum(stop - start), 4) AS good_time, sum(floor((stop - start) / 14400e0))::BIGINT AS n_segments
  FROM sess GROUP BY 1""")
def t5(spark, sf):
    return round_all(I.capacity(sessions(spark, sf), ["user_id"], SEG), 4)


@query("t6_fixed_segments", f"WITH {SESS}, {SEGS} SELECT user_id, round(t0, 6) AS t0 FROM seg")
def t6(spark, sf):
    return round_all(I.segments(sessions(spark, sf), SEG).select("user_id", "t0"))


@query("t6_grid_segments", f"""WITH {SESS}, f AS (SELECT user_id, ceil(start / 900e0) * 900e0 AS first, stop FROM sess),
  n AS (SELECT *, floor((stop + 1e-9 - first) / 14400e0)::BIGINT AS n FROM f)
  SELECT user_id, round(first + i * 14400e0, 6) AS t0 FROM (SELECT user_id, first, unnest(range(0, n)) AS i FROM n WHERE n > 0)""")
def t6b(spark, sf):
    return round_all(I.segments(sessions(spark, sf), SEG, grid=900.0, slack=1e-9).select("user_id", "t0"))


@query("t7_clean_segments", f"""WITH {SESS}, {BURSTS}, {SEGS}, {REMOVED} SELECT user_id, count(*) AS n_segments,
  count(CASE WHEN removed THEN 1 END) AS n_removed FROM rem GROUP BY 1""")
def t7(spark, sf):
    s = I.clean_segments(sessions(spark, sf), bursts(spark, sf), ["user_id"], SEG)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"))


@query("t30_prefix_sufficiency", f"""WITH {SESS}, n AS (SELECT *, floor((stop - start) / 14400e0)::BIGINT AS n FROM sess),
  c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start) - n AS before FROM n)
  SELECT user_id, sum(n)::BIGINT AS total, round(max(CASE WHEN before < 20 AND before + n >= 20 THEN start + (20 - before) * 14400e0 END), 6) AS cutoff FROM c GROUP BY 1""")
def t30(spark, sf):
    return round_all(I.prefix_stop(sessions(spark, sf), ["user_id"], SEG, 20))

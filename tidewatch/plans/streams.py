"""Streams over the given events, drained with the availableNow trigger and closed, so that their results are those of a batch."""

from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.plans.views import T0_US
from tidewatch.sources.files import scratch
from tidewatch.sources.tables import table
from tidewatch.streaming import streams as S


def source(spark, sf, closing=None):
    table(spark, sf, "events")
    return S.read_events(spark, S.table_glob(sf, "events"), closing=closing)


def seconds(c):
    return (F.unix_micros(c) - F.lit(T0_US)) / F.lit(1e6)


EV = "e AS (SELECT *, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"


@query("r1_stream_light_curve", f"""WITH {EV} SELECT event_type, floor(t / 3600) * 3600e0 AS start, count(*) AS n FROM e GROUP BY event_type, floor(t / 3600)""")
def r1(spark, sf):
    closing = scratch(spark, "closing")
    d = S.drain(S.tumbling_counts(source(spark, sf, closing), ["event_type"], "ts", "1 hour", "2 hours"), closing=closing)
    return d.select("event_type", seconds(F.col("start")).alias("start"), "n")


@query("r2_stream_sessions", f"""WITH {EV}, l AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS cut FROM e),
  g AS (SELECT user_id, t, sum(cut) OVER (PARTITION BY user_id ORDER BY t) AS g FROM l), s AS (SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM g GROUP BY user_id, g)
  SELECT user_id, round(start, 6) AS start, round(stop, 6) AS stop, n FROM s""")
def r2(spark, sf):
    closing = scratch(spark, "closing")
    d = S.drain(S.gap_sessions(source(spark, sf, closing), ["user_id"], "ts", "12 hours", "2 hours"), closing=closing)
    return d.select("user_id", F.round(seconds(F.col("start")), 6).alias("start"), F.round(seconds(F.col("stop")), 6).alias("stop"), "n")


@query("r3_stream_segment_colours", f"""WITH {EV}, g AS (SELECT user_id % 6 AS obs, floor(t / 86400) AS w, count(CASE WHEN k < 30 THEN 1 END) AS a, count(CASE WHEN k >= 30 AND k < 60 THEN 1 END) AS b, count(CASE WHEN k >= 60 AND k < 100 THEN 1 END) AS c
  FROM e GROUP BY ALL) SELECT obs, w * 86400e0 AS start, a, b, c, round(b::DOUBLE / nullif(a, 0), 9) AS c1, round(c::DOUBLE / nullif(b, 0), 9) AS c2 FROM g""")
def r3(spark, sf):
    closing = scratch(spark, "closing")
    e = source(spark, sf, closing).withColumns({"obs": F.col("user_id") % 6, "k": F.get_json_object("props", "$.k").cast("int")})
    d = S.drain(S.band_counts(e, ["obs"], "ts", "1 day", "2 hours", "k", {"a": (0, 30), "b": (30, 60), "c": (60, 100)}), closing=closing)
    return d.select("obs", seconds(F.col("start")).alias("start"), "a", "b", "c", F.round("c1", 9).alias("c1"), F.round("c2", 9).alias("c2"))


@query("r4_stream_bursts", """WITH b AS (SELECT event_type AS source, floor(epoch_us(ts) / 3600e6) * 3600e0 AS t, count(*)::HUGEINT AS n FROM events GROUP BY 1, 2),
  r AS (SELECT *, count(*) OVER w AS k, sum(n) OVER w AS s1, sum(n * n) OVER w AS s2 FROM b WINDOW w AS (PARTITION BY source ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  h AS (SELECT source, t, n FROM r WHERE k >= 24 AND k * n > s1 AND (k * n - s1) * (k * n - s1) > 4 * (k * s2 - s1 * s1)),
  i AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source ORDER BY t) < 10800 THEN 0 ELSE 1 END AS starts FROM h),
  g AS (SELECT *, sum(starts) OVER (PARTITION BY source ORDER BY t) AS g FROM i)
  SELECT source, min(t) AS "first", max(t) AS "last", max(n)::DOUBLE AS peak, count(*) AS size FROM g GROUP BY source, g""")
def r4(spark, sf):
    closing = scratch(spark, "closing")
    curve = S.binned(source(spark, sf, closing), "event_type", "ts", "1 hour", "2 hours")
    return S.drain(S.stateful(curve, "event_type", S.BurstDetector(2.0, 10800.0, 24, 3600.0), S.BURST_SCHEMA, timed=True), closing=closing)


@query("r5_stream_prefix", f"""WITH {EV}, l AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS cut FROM e),
  g AS (SELECT user_id, t, sum(cut) OVER (PARTITION BY user_id ORDER BY t) AS g FROM l), s AS (SELECT user_id, min(t) AS start, floor((max(t) - min(t)) / 14400e0)::BIGINT AS n FROM g GROUP BY user_id, g),
  c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start) - n AS before FROM s) SELECT user_id, round(max(start + (20 - before) * 14400e0), 4) AS cutoff FROM c WHERE before < 20 AND before + n >= 20 GROUP BY 1""")
def r5(spark, sf):
    closing = scratch(spark, "closing")
    bins = S.binned(source(spark, sf, closing), "user_id", "ts", "1 hour", "2 hours")
    d = S.drain(S.stateful(S.in_buckets(bins, "user_id"), "bucket", S.PrefixStop(43200.0, 14400.0, 20), S.PREFIX_SCHEMA), closing=closing)
    return d.select(F.col("key").cast("long").alias("user_id"), F.round(F.col("cutoff") - T0_US / 1e6, 4).alias("cutoff"))


@query("r6_stream_deduplicated", """SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, 0::BIGINT AS dropped FROM events GROUP BY 1""")
def r6(spark, sf):
    e = source(spark, sf)
    twice = e.select(*e.columns, F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    d, dropped = S.drain_counted(S.in_time(twice.drop("copy"), ["event_id"], "ts", "2 hours"))
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.lit(dropped).cast("long").alias("dropped"))


@query("r7_stream_ingest", "SELECT doc_id, lang, n_chars, sha256(text) AS sha256 FROM documents")
def r7(spark, sf):
    out, progress = scratch(spark, "manifest"), scratch(spark, "progress")
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    s = spark.readStream.schema(cols).parquet(S.table_glob(sf, "documents")).select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("sha256"))
    S.ingest(s, ["doc_id"], out, progress)
    return S.ingest(s, ["doc_id"], out, progress)

"""Bindings of the given tables to observations, events, scores, positions and vectors, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import mjd
from tidewatch.sources.tables import table

DETECTORS = ["click", "error", "purchase", "signup", "view"]
T0_US = 1704067200000000  # 2024-01-01 in microseconds, the zero of the event clock


def events(spark, sf):
    e = table(spark, sf, "events")
    det = F.array_position(F.array(*[F.lit(d) for d in DETECTORS]), F.col("event_type")).cast("int") - 1
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(T0_US)) / F.lit(1e6)
    return e.select("event_id", "user_id", t.alias("t"), "event_type", det.alias("det"), "value",
                    F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENTS = """ev AS (SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_type,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS det,
  value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


def observations(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("source_id"), mjd("o_orderdate").alias("mjd"),
                    F.col("o_totalprice").alias("rate"), F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("priority"))


OBS = """obs AS (SELECT o_orderkey AS obs_id, o_custkey AS source_id, epoch_us(o_orderdate) / 86400e6 + 40587 AS mjd,
  o_totalprice AS rate, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""


def scores(spark, sf):
    li = table(spark, sf, "lineitem")
    a = F.col("l_quantity") / 51.0
    return li.select(F.col("l_suppkey").alias("source_id"),
                     F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate"))).alias("obs_id"),
                     (F.col("l_suppkey") % 5 == 0).alias("positive"), F.col("l_returnflag").alias("stratum"),
                     a.alias("score_a"), ((a + F.col("l_discount") * 10.0) / 2.0).alias("score_b"))


SCORES = """oof AS (SELECT l_suppkey AS source_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, (epoch_us(l_shipdate) // 86400000000)::BIGINT) AS obs_id,
  l_suppkey % 5 = 0 AS positive, l_returnflag AS stratum, l_quantity / 51e0 AS score_a,
  (l_quantity / 51e0 + l_discount * 10e0) / 2e0 AS score_b FROM lineitem)"""


def long_scores(spark, sf):
    """The scores with one row per model."""
    return by_model(scores(spark, sf))


def by_model(s, *more):
    """One row per model of rows with both scores; ``more`` columns are kept."""
    pair = F.explode(F.array(F.struct(F.lit("A").alias("model"), F.col("score_a").alias("score")),
                             F.struct(F.lit("B").alias("model"), F.col("score_b").alias("score")))).alias("p")
    return s.select("source_id", "obs_id", "positive", "stratum", *more, pair).select("p.model", "source_id", "obs_id", "positive", "stratum", "p.score", *more)


LONG_SCORES = SCORES + """, lng AS (SELECT 'A' AS model, source_id, obs_id, positive, stratum, score_a AS score FROM oof
  UNION ALL SELECT 'B', source_id, obs_id, positive, stratum, score_b FROM oof)"""


def _position(key):
    k = F.col(key)
    ra = (k * F.lit(137.508)) % 360.0
    dec = F.degrees(F.asin(((k * 7919) % 1999) / 999.5 - 1.0))
    return ra, dec


def sky(spark, sf, name):
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
    ra, dec = _position(key)
    return table(spark, sf, name).select(F.col(key).alias("id"), ra.alias("ra"), dec.alias("dec"), (F.col(key) % 5 == 0).alias("positive"))


def sky_sql(name):
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
    return f"""{name}_sky AS (SELECT {key} AS id, ({key} * 137.508e0) % 360e0 AS ra,
  degrees(asin((({key} * 7919) % 1999) / 999.5e0 - 1e0)) AS dec, {key} % 5 = 0 AS positive FROM {name})"""


SEP = """degrees(acos(greatest(-1e0, least(1e0, sin(radians({d1})) * sin(radians({d2}))
  + cos(radians({d1})) * cos(radians({d2})) * cos(radians({r1}) - radians({r2}))))))"""


def sep_sql(a, b):
    return SEP.format(r1=f"{a}.ra", d1=f"{a}.dec", r2=f"{b}.ra", d2=f"{b}.dec")


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    rate = F.transform("embedding", lambda x: F.abs(x.cast("double")) + F.lit(0.01))
    return e.select("vec_id", (F.col("vec_id") % 20).alias("source_id"), (F.col("label") < 3).alias("positive"), "label",
                    F.transform("embedding", lambda x: x.cast("double")).alias("x"), rate.alias("rate"))


# one row per (vec_id, bin), bins numbered from 1
VECTORS = """vec AS (SELECT vec_id, vec_id % 20 AS source_id, label < 3 AS positive, label, unnest(range(1, 65)) AS bin,
  unnest(embedding)::DOUBLE AS x FROM embeddings), rvec AS (SELECT vec_id, source_id, positive, label, bin, x,
  abs(x) + 0.01e0 AS rate, 3e0 * pow(1.04e0, bin - 1) AS e_lo, 3e0 * pow(1.04e0, bin) AS e_hi FROM vec)"""

EDGES = [(3.0 * 1.04 ** i, 3.0 * 1.04 ** (i + 1)) for i in range(64)]


def rounded(c, digits):
    """To so many digits as the SQL's round() does it: the double times 10 ** digits to the nearest whole number, a half away from 0.

    Spark's round looks at the decimal text instead, where 1.0015625, whose double lies below that, is a half.
    """
    return F.round(c * 10.0**digits) / 10.0**digits


def round_all(df, digits=6, skip=()):
    """Round every double so that the sum order of the engines does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])

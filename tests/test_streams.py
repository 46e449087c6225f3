"""Stateful streams against a plain loop over the same rows."""

import glob
import os

import pandas as pd
from pyspark.sql import functions as F

from tidewatch.sources.files import scratch
from tidewatch.sources.tables import table
from tidewatch.streaming import streams as S

SF = "/root/testdata/sf0.001"


def test_burst_detector_equals_loop(spark):
    closing = scratch(spark, "closing")
    curve = S.binned(S.read_events(spark, S.table_glob(SF, "events"), closing=closing), "event_type", "ts", "6 hours", "2 hours")
    got = S.drain(S.stateful(curve, "event_type", S.BurstDetector(1.0, 43200.0, 5, 21600.0), S.BURST_SCHEMA, timed=True), closing=closing).toPandas()
    e = table(spark, SF, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).toPandas()
    want = []
    for k, g in e.assign(b=e.t // 21600 * 21600).groupby("event_type"):
        n = mean = m2 = 0.0
        cur = None
        for t, v in g.groupby("b").size().items():
            if cur and t - cur[1] >= 43200:
                want.append((k, *cur))
                cur = None
            if n >= 5 and v > mean + (m2 / n) ** 0.5:
                cur = [cur[0], t, max(cur[2], v), cur[3] + 1] if cur else [t, t, v, 1]
            n, d = n + 1, v - mean
            mean += d / n
            m2 += d * (v - mean)
        if cur:
            want.append((k, *cur))
    want = pd.DataFrame(want, columns=["source", "first", "last", "peak", "size"])
    assert len(want) > 5
    a = got.sort_values(["source", "first"]).reset_index(drop=True)
    b = want.sort_values(["source", "first"]).reset_index(drop=True)
    assert len(a) == len(b)
    assert (a.source == b.source).all() and (a["size"] == b["size"]).all() and (abs(a["first"] - b["first"]) < 1e-6).all()


def test_ingest_twice_adds_nothing(spark):
    src, out, progress = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    spark.range(10).write.parquet(src)
    for i in range(2):
        s = spark.readStream.schema("id bigint").parquet(src)
        assert S.ingest(s, ["id"], out, progress).count() == 10
    spark.range(5, 15).write.mode("append").parquet(src)
    s = spark.readStream.schema("id bigint").parquet(src)
    got = S.ingest(s, ["id"], out, progress)
    assert got.count() == 15 and got.distinct().count() == 15


def test_ingest_survives_a_lost_commit_and_a_new_checkpoint(spark):
    src, out, progress = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    stream = lambda: spark.readStream.schema("id bigint").parquet(src)
    spark.range(10).write.parquet(src)
    S.ingest(stream(), ["id"], out, progress)
    spark.range(5, 20).write.mode("append").parquet(src)
    assert S.ingest(stream(), ["id"], out, progress).count() == 20
    os.remove(f"{progress}/commits/1")
    for crc in glob.glob(f"{progress}/commits/.1.crc"):
        os.remove(crc)
    assert sorted(r.id for r in S.ingest(stream(), ["id"], out, progress).collect()) == list(range(20))
    spark.range(18, 25).write.mode("append").parquet(src)
    assert sorted(r.id for r in S.ingest(stream(), ["id"], out, scratch(spark, "progress")).collect()) == list(range(25))


def test_late_rows_are_dropped_and_copies_removed(spark):
    src, out, progress = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    for rows in ([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00")], [(3, "2024-01-01 08:00:00"), (4, "2024-01-01 11:45:00")]):
        d = spark.createDataFrame(rows, "id long, ts string").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))
        d.coalesce(1).write.mode("append").parquet(src)
        e = S.read_events(spark, src, "id bigint, ts timestamp_ntz")
        got, dropped = S.drain_counted(S.in_time(e, ["id"], "ts", "1 hour"), checkpoint=progress, out=out)
    assert sorted(r.id for r in got.collect()) == [1, 2, 4] and dropped == 1


def at(spark, src, rows):
    d = spark.createDataFrame(rows, "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    full = d.selectExpr("0L as event_id", "ts", "user_id", "cast(user_id as string) as event_type", "1D as value", "'{}' as props")
    full.coalesce(1).write.mode("append").parquet(src)


def test_open_windows_and_sessions_appear_when_the_stream_ends(spark):
    src, closing = scratch(spark, "in"), scratch(spark, "closing")
    at(spark, src, [(1, "2024-01-01 10:10:00"), (1, "2024-01-01 10:50:00"), (2, "2024-01-01 18:00:00")])
    events = lambda c=None: S.read_events(spark, src, closing=c)
    opened = S.tumbling_counts(events(), ["user_id"], "ts", "1 hour", "2 hours")
    assert [(r.user_id, r.n) for r in S.drain(opened).collect()] == [(1, 2)]
    whole = S.drain(S.tumbling_counts(events(closing), ["user_id"], "ts", "1 hour", "2 hours"), closing=closing)
    assert sorted((r.user_id, r.n) for r in whole.collect()) == [(1, 2), (2, 1)]
    other = scratch(spark, "closing")
    sessions = S.drain(S.gap_sessions(events(other), ["user_id"], "ts", "30 minutes", "2 hours"), closing=other)
    assert sorted((r.user_id, r.n) for r in sessions.collect()) == [(1, 1), (1, 1), (2, 1)]


def test_a_silent_key_gives_its_burst_once_the_watermark_has_passed(spark):
    src, out, progress = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    quiet = [(1, f"2024-01-01 {h:02d}:00:00") for h in range(6)]
    at(spark, src, quiet + [(1, "2024-01-01 06:00:00")] * 5 + [(2, "2024-01-01 09:30:00")])

    def bursts():
        curve = S.binned(S.read_events(spark, src), "event_type", "ts", "1 hour", "0 seconds")
        detector = S.BurstDetector(2.0, 7200.0, 3, 3600.0)
        return [(r["first"] % 86400 / 3600, r["last"] % 86400 / 3600, r["peak"], r["size"]) for r in S.drain(S.stateful(curve, "event_type", detector, S.BURST_SCHEMA, timed=True), checkpoint=progress, out=out).collect()]

    # the watermark is 9:30: no bin from 6:00 to before 8:00 is open, which is when the burst's last partner could start
    assert bursts() == [(6.0, 6.0, 5.0, 1)]
    at(spark, src, [(1, "2024-01-01 12:10:00")] * 9 + [(2, "2024-01-01 13:30:00")])
    assert len(bursts()) == 1
    at(spark, src, [(2, "2024-01-01 20:00:00")])
    assert sorted(bursts())[1:] == [(12.0, 12.0, 9.0, 1)]

"""One call of the prefix processor serves many keys, over several runs of a stream."""

from pyspark.sql import functions as F

from tidewatch.sources.files import scratch
from tidewatch.streaming import streams as S


def write(spark, src, rows):
    spark.createDataFrame(rows, "user_id long, s double").selectExpr("0L as event_id", "cast(timestamp_micros(cast(s * 1e6 as bigint)) as timestamp_ntz) as ts", "user_id", "'a' as event_type", "1D as value", "'' as props").write.mode("append").parquet(src)


def test_keys_of_a_bucket_are_told_apart_over_runs(spark):
    src, out, progress, closing = (scratch(spark, n) for n in ("in", "out", "progress", "closing"))
    users = [None, 2**60 + 1, *range(40)]
    base = 1_704_067_200
    first = [(u, base + 600.0 * i + j) for j, u in enumerate(users) for i in range(4)]
    # 30 minutes so far; then half of the keys go on without a gap and the others start anew
    later = [(u, base + 2400.0 + (0 if j % 2 else 40000.0) + 600.0 * i + j) for j, u in enumerate(users) for i in range(9)]
    calls = spark.sparkContext.accumulator(0)

    class Counted(S.PrefixStop):
        def handleInputRows(self, key, rows, timer_values):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timer_values)

    def run(closing=None):
        bins = S.binned(S.read_events(spark, src, closing=ends), "user_id", "ts", "10 minutes", "1 minute")
        return S.drain(S.stateful(S.in_buckets(bins, "user_id", 3), "bucket", Counted(3600.0, 1200.0, 4), S.PREFIX_SCHEMA), checkpoint=progress, out=out, closing=closing)

    ends = closing
    write(spark, src, first)
    assert run().count() == 0
    write(spark, src, later)
    got = {r.key: r.cutoff - base for r in run(closing).select("key", "cutoff").collect()}
    assert set(got) == {None if u is None else str(u) for u in users}
    for j, u in enumerate(users):
        # 2,400 s reach to the last event of the first run for keys that go on: one stretch; else 1 whole segment of 1,800 s and 3 more after the gap
        assert abs(got[None if u is None else str(u)] - (4800.0 + j if j % 2 else 42400.0 + j + 3600.0)) < 1e-3
    assert 0 < calls.value <= 3 * 6

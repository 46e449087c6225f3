"""Structured Streaming forms of the event operators.

Every stream reads files with a declared schema, keeps its progress in a checkpoint folder and writes Parquet, so that it can stop and go on
without loss or repetition. Windows are emitted once their watermark has passed; a bounded run is closed by a row behind all others, which lets the watermark
pass everything that is still open.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewatch.sources.files import scratch

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Time of the row that closes a stream. Its own window stays open, so it never appears in a result.
END = "2200-01-01 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_glob(folder: str, name: str) -> str:
    """A path for a file stream that fits a table stored as one file and one stored as a folder."""
    return f"{folder.rstrip('/')}/{name}.parque[t]"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, time: str = "ts", closing: str | None = None) -> DataFrame:
    """File stream with an event-time column (wall-clock times are read as UTC). closing: a folder of its own for the row that end() writes."""
    events = spark.readStream.schema(schema).parquet(path)
    if closing:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(closing)
        events = events.unionByName(spark.readStream.schema(schema).parquet(closing))
    return events.withColumn(time, F.col(time).cast("timestamp"))


def end(spark: SparkSession, closing: str, schema: str = EVENT_SCHEMA, time: str = "ts") -> None:
    """No more events will come: a row at END, null but for its time. Events that are read later in spite of it are late."""
    empty = spark.createDataFrame([], schema)
    row = spark.range(1).select(*[F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
    row.write.mode("append").parquet(closing)


def drain(stream: DataFrame, schema: str | None = None, checkpoint: str | None = None, out: str | None = None, closing: str | None = None) -> DataFrame:
    """Run a stream over all files present and read what it wrote."""
    return drain_counted(stream, schema, checkpoint, out, closing)[0]


def drain_counted(stream: DataFrame, schema: str | None = None, checkpoint: str | None = None, out: str | None = None, closing: str | None = None) -> tuple[DataFrame, int]:
    """What drain() gives, and how many rows this run dropped because they came after the watermark.

    closing: the folder given to read_events(). After all files the stream is ended there and run on, so that windows, sessions and bursts which are still open appear;
    without it they wait for the next run. The closing row comes in a batch of its own: no event of this run is late because of it.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, "stream")
    checkpoint = checkpoint or scratch(spark, "progress")
    dropped = run_available(stream, checkpoint, out)
    if closing:
        end(spark, closing)
        dropped += run_available(stream, checkpoint, out)
    return spark.read.schema(stream.schema if schema is None else schema).parquet(out), dropped


def run_available(stream: DataFrame, checkpoint: str, out: str) -> int:
    """Append what the stream gives for the files present; how many rows came after the watermark."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])


def tumbling_counts(events: DataFrame, keys: Sequence[str], time: str, width: str, delay: str) -> DataFrame:
    """Counts per epoch-aligned window."""
    g = events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "n")


def gap_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Good intervals: stretches of events without a longer gap; the stop is the last event, not the end of the gap."""
    g = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("stop"))
    return g.select(*keys, F.col("w.start").alias("start"), "stop", "n")


def band_counts(events: DataFrame, keys: Sequence[str], time: str, width: str, delay: str, channel: str, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Counts per channel band and colours in fixed segments."""
    c = F.col(channel)
    g = events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(*[F.count(F.when((c >= lo) & (c < hi), 1)).alias(b) for b, (lo, hi) in bands.items()])
    a, b, d = list(bands)[:3]
    return g.select(F.col("window.start").alias("start"), *keys, *bands, F.try_divide(F.col(b), F.col(a)).alias("c1"), F.try_divide(F.col(d), F.col(b)).alias("c2"))


def in_time(events: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """Events inside the watermark, each identity once; rows that arrive later than the delay are dropped by the engine and counted in its progress."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def binned(events: DataFrame, key: str, time: str, width: str, delay: str) -> DataFrame:
    """One row per (key, bin): event time of the bin (at), its start, count, first and last event. Map-side sums reach the state store, so a busy key sends one row per bin."""
    g = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(time)).alias("_a"), F.max(F.unix_micros(time)).alias("_b"))
    return g.select(key, F.window_time("w").alias("at"), (F.unix_micros("w.start") / F.lit(1e6)).alias("t"), "n", (F.col("_a") / F.lit(1e6)).alias("first_t"), (F.col("_b") / F.lit(1e6)).alias("last_t"))


class BurstDetector(StatefulProcessor):
    """Bins above the mean plus n_sigma deviations of all earlier bins of their key; high bins closer than ``merge`` form one burst, emitted when it has ended.

    A burst has ended when a later bin starts ``merge`` or more after its last one, or when the watermark has passed every bin that could still join it: a timer
    says so for keys that fall silent. Counts, their sums and sums of squares are whole numbers, so the comparison is exact. width: seconds in a bin.
    """

    def __init__(self, n_sigma: float, merge: float, warm_up: int, width: float):
        self.n_sigma, self.merge, self.warm_up, self.width = n_sigma, merge, warm_up, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stats = handle.getValueState("stats", "n bigint, s1 bigint, s2 bigint, first double, last double, peak double, size bigint")

    def over(self, last: float) -> int:
        """The watermark, in ms, from which on no bin can join a burst with this last bin."""
        return math.ceil((last + self.merge + self.width) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, s1, s2, first, last, peak, size = self.stats.get() if self.stats.exists() else (0, 0, 0, 0.0, 0.0, 0.0, 0)
        out = []
        bins = pd.concat(list(rows))[["t", "n"]].sort_values("t")
        for t, v in zip(bins["t"].tolist(), bins["n"].tolist()):
            if size and t - last >= self.merge:
                out.append((key[0], first, last, peak, size))
                size = 0
            above = n * v - s1
            if n >= self.warm_up and above > 0 and above * above > self.n_sigma**2 * (n * s2 - s1 * s1):
                first, peak = (first, max(peak, float(v))) if size else (t, float(v))
                last, size = t, size + 1
            n, s1, s2 = n + 1, s1 + v, s2 + v * v
        self.stats.update((n, s1, s2, first, last, peak, size))
        if size:
            self.handle.registerTimer(self.over(last))
        yield pd.DataFrame(out, columns=["source", "first", "last", "peak", "size"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, s1, s2, first, last, peak, size = self.stats.get()
        out = []
        # the timer of a burst that went on, or was emitted since, finds another time or none
        if size and self.over(last) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], first, last, peak, size))
            self.stats.update((n, s1, s2, first, last, peak, 0))
        yield pd.DataFrame(out, columns=["source", "first", "last", "peak", "size"])

    def close(self) -> None:
        pass


BURST_SCHEMA = "source string, first double, last double, peak double, size bigint"


class PrefixStop(StatefulProcessor):
    """Counts whole segments of gap-free time per key from binned events and emits the key once the wanted number is reached.

    Bins are not longer than the gap, so the first and last event of a bin decide as all events would. Later bins are ignored. One call and one state value serve all keys of a
    bucket (in_buckets()), whose rows name them in ``key``: a call costs far more than a key's bins.
    """

    def __init__(self, gap: float, length: float, wanted: int):
        self.gap, self.length, self.wanted = gap, length, wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("prefix", "key array<string>, start array<double>, last array<double>, whole array<bigint>, done array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = {k: v for k, *v in zip(*self.state.get())} if self.state.exists() else {}
        out = []
        bins = pd.concat(list(rows))[["key", "first_t", "last_t"]].sort_values("first_t")
        for k, a, b in zip(bins["key"].tolist(), bins["first_t"].tolist(), bins["last_t"].tolist()):
            start, last, whole, done = known.get(k) or (a, a, 0, False)
            if done:
                continue
            if a - last > self.gap:
                whole += int((last - start) // self.length)
                start = a
            if whole + int((b - start) // self.length) >= self.wanted:
                out.append((k, start + (self.wanted - whole) * self.length))
                done = True
            known[k] = (start, b, whole, done)
        self.state.update(tuple(list(c) for c in zip(*((k, *v) for k, v in known.items()))))
        yield pd.DataFrame(out, columns=["key", "cutoff"])

    def close(self) -> None:
        pass


PREFIX_SCHEMA = "key string, cutoff double"


def in_buckets(events: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """The key as text, and in ``bucket`` its share of all keys for a processor that serves many of them at once. The number of buckets belongs to a stream's checkpoint."""
    return events.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)), "key": F.col(key).cast("string")}).drop(key)


def stateful(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, timed: bool = False) -> DataFrame:
    """A keyed stateful operator; its state lives in RocksDB. timed: the processor has event-time timers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if timed else "None")


def ingest(stream: DataFrame, key: Sequence[str], out: str, checkpoint: str) -> DataFrame:
    """Append only rows whose key is not in the table yet.

    A batch has a folder of its own, named by the stream's identity (kept in its checkpoint) and the batch number. It is compared with all other folders and then replaces
    its own, so that a batch repeated after a failure neither loses nor repeats rows, and a stream with a new checkpoint leaves what is there alone.
    """
    spark, schema = stream.sparkSession, stream.schema
    keep = StructType([*schema.fields, StructField("query", StringType()), StructField("epoch", LongType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/query=none/epoch=-1")

    def stored(session: SparkSession) -> DataFrame:
        return session.read.schema(keep).option("basePath", out).parquet(f"{out}/query=*")

    def add(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        mine = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        others = stored(session).where((F.col("query") != mine) | (F.col("epoch") != epoch))
        fresh = batch.dropDuplicates(list(key)).join(others.select(*key).distinct(), list(key), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/query={mine}/epoch={epoch}")

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stored(spark).drop("query", "epoch")

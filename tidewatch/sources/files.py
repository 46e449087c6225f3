"""File sources and sinks: CSV, white-space text, JSON lines, manifests, vector tables and report text."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.columns import fixed_text, null_if_nan
from tidewatch.session import checkpoint_dir


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that it neither ranks largest nor spoils sums."""
    return df.withColumns({c: null_if_nan(c) for c, t in df.dtypes if t in ("float", "double")})


def read_table(spark: SparkSession, path: str, schema: StructType | str, booleans: Sequence[str] = ()) -> DataFrame:
    """CSV with a declared schema; identifiers stay text, boolean text is repaired, and a number that is none is null."""
    df = without_nan(spark.read.csv(path, schema=schema, header=True))
    return df.withColumns({b: F.lower(F.trim(b)) == "true" for b in booleans}) if booleans else df


def read_spaced(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Text columns divided by white space, named and typed by position; a short line has nulls at its end."""
    parts = F.split(F.trim("value"), r"\s+")
    return without_nan(spark.read.text(path).select(*[F.get(parts, F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(columns.items())]))


def append_json(df: DataFrame, path: str) -> str:
    df.write.mode("append").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def union_tagged(frames: Mapping[str, DataFrame], key: Sequence[str], tag: str = "sample") -> DataFrame:
    """Union of frames with their tag; a key found in several keeps the row of the first frame."""
    out = None
    for i, (name, df) in enumerate(frames.items()):
        d = df.withColumns({tag: F.lit(name), "_prio": F.lit(i)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in key]
    best = out.groupBy(*key).agg(F.min_by(F.struct(*rest), "_prio").alias("_b"))
    return best.select(*key, "_b.*").drop("_prio")


def manifest(df: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """Bytes and SHA-256 of every content cell (text or binary)."""
    c = F.col(content).cast("binary")
    return df.select(*key, F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("sha256"))


def folder_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of the files of a folder."""
    return manifest(spark.read.format("binaryFile").load(path), ["path"], "content")


def pending(work: DataFrame, done: DataFrame, key: Sequence[str], at: str | None = None, ok: Column | None = None) -> DataFrame:
    """Work whose latest log row is absent or, with ``ok``, not successful."""
    log = done
    if at is not None:
        rest = [c for c in done.columns if c not in key]
        log = done.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_b")).select(*key, "_b.*")
    if ok is not None:
        log = log.where(ok)
    return work.join(log.select(*key).distinct(), list(key), "left_anti")


def write_vectors(df: DataFrame, path: str, partition: Sequence[str] = ()) -> str:
    """Vector columns as arrays in Parquet, rows aligned by key rather than by position."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return path


def found_only(df: DataFrame, lookup: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows whose key is flagged in a lookup table."""
    return df.join(lookup.where(flag).select(key).distinct(), key, "left_semi")


def interval_text(point, low, high, digits: int = 3) -> Column:
    """'point [low,hi]' text of a report."""
    return F.concat(fixed_text(point, digits), F.lit(" ["), fixed_text(low, digits), F.lit(","), fixed_text(high, digits), F.lit("]"))

"""Session set-up shared by the entry points, the tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cpus: str | int = "*", partitions: int = 8, app: str = "tidewatch") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is named, a local session gets a fresh folder of its own, removed at its end; on a cluster executors would write to
    their own disks, so that is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = configured or own_folder(spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(current)
    return configured or current


def own_folder(master: str) -> str:
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Spread rows over all shuffle partitions before a step that multiplies them.

    A small table that was coalesced to a few partitions would otherwise do the multiplied work in a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)

"""Session helpers: local sessions for tests and benches, and the few settings operators need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wayledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WAYLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder the cluster names. Where none is named, a local session (tests) gets a folder of
    its own; on a cluster that is an error, as no machine's own folder outlives the machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayledger-checkpoint-"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most max_rows rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back. Unlike a checkpoint, what the optimizer knows of the old plan is
    gone too, so that a loop's plans don't grow from round to round."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)

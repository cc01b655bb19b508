"""Signals and feeds as streams: one signal per place and hour, expiry by watermark, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(signals: DataFrame, late: str = "6 hours") -> DataFrame:
    """The last signal per place and hour of ``place, ts, severity, eta``: works on streams (with a watermark) and tables alike."""
    if signals.isStreaming:
        signals = signals.withWatermark("ts", late)
    last = F.max_by(F.struct("ts", "severity", "eta"), F.struct("ts", "severity", "eta"))
    return signals.groupBy("place", F.window("ts", "1 hour").alias("w")).agg(last.alias("s")).select("place", F.col("w.start").alias("hour"), "s.ts", "s.severity", "s.eta")


def upsert_each_batch(merge: Callable[[DataFrame, DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges a batch into the newest version under ``path`` and writes the next.

    Versions are named by batch id, so a batch that runs again overwrites its own version and nothing else. One writer
    at a time.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        before = [n for n in done if n < number]
        old = spark.read.parquet(f"{path}/v{max(before)}") if before else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return run

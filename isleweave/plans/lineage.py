"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, materialised once as a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, shared by all executors. Where that is unset,
    a session on one machine (tests) gets a temporary folder, and one on a cluster an error: files in a folder of the
    driver's machine could not be read elsewhere.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="isleweave-"))
    return df.checkpoint(eager=True)

"""Making this package importable in the Python workers of a session."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application; workers need no installation of it.

    The archive lies beside the driver only, whose file server hands it to executors, new ones after a loss included.
    """
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="isleweave-")) / "isleweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(key)

"""Makes the package importable on workers that do not share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application and only where they cannot import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)

    def probe(rows):  # pickled by value: a worker without the package can run it
        import importlib.util

        yield importlib.util.find_spec("tessera") is not None

    probe.__module__ = "__main__"
    n = max(8, 2 * context.defaultParallelism)  # more tasks than cores, so that every executor is asked
    if all(context.parallelize(range(n), n).mapPartitions(probe).collect()):
        return
    # the driver serves this file to executors, so its own folder will do
    place = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tessera.zip")
    with zipfile.ZipFile(place, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(place)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()

"""Session set-up, durable intermediate results and shared folders."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers on this file system import the package wherever the driver was started."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, known) if p)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a checkpoint in the shared folder of ``spark.checkpoint.dir``; only a local session may go without that setting."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="waymark-"))
    return df.checkpoint(eager=True)

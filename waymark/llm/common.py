"""Shared helpers: durable checkpoints, shared folders and joins on skewed keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+`` words.  ``bytes.split()`` splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without that setting (tests) gets a private temporary folder
    once; a cluster has to name a shared one.
    """
    context = spark.sparkContext
    named, made = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if not named:
        if made:
            return made
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="waymark-")
    if not made:
        context.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of ids or names that may be broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: A key with more than this part of all rows is hot; so there are at most as many hot keys.
HOT = 1000


def join_spread(rows: DataFrame, named: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` left joined to ``named(key, n, ...)``, where ``n`` is how many rows have the key.

    Hot keys, ``HOT`` at most, are joined by a broadcast; their rows, and those
    with a null key, are dealt evenly in the shuffle that joins the others.
    """
    columns = [c for c in named.columns if c not in (key, n)]
    hot = named.where(F.col(n) * HOT > total).select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in columns)).limit(HOT)
    rest = named.where(F.col(n) * HOT <= total).select(F.col(key).alias("__key"), F.lit(0).cast("bigint").alias("__zero"), *columns)
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    out = out.withColumn("__salt", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id() + 1).otherwise(0))
    out = out.join(rest, (F.coalesce(F.col(key), F.lit(0).cast(rows.schema[key].dataType)) == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left")
    return out.select(*rows.columns, *(F.coalesce(f"__hot_{c}", c).alias(c) for c in columns))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a replicated-storage checkpoint, never a local one."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one parquet table, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows of whole texts that go to Python at once; Spark's own 10,000 hold a few tens of MB in each task's JVM buffers and worker.
TEXT_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``TEXT_ROWS``; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def small_reads(spark: SparkSession) -> None:
    """Bound the rows that Parquet decodes at once by ``TEXT_ROWS``; Spark's own 4,096 whole texts need byte arrays of tens of MB in each task."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def as_bytes(column: str) -> F.Column:
    """UTF-8 bytes of a string column, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))

"""Extraction cache: a Parquet table keyed by path and modification time, in folders by a hash of the path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import durable

VERSION = 2
#: Folders of the table, by a hash of the path; a changed file rewrites its own.
BUCKETS = 256


def bucket(path: str = "path") -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def split(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (path and time equal) and misses."""
    keys = cached.select("path", "modified").distinct()
    return files.join(keys, ["path", "modified"], "left_semi"), files.join(keys, ["path", "modified"], "left_anti")


def stored(spark: SparkSession, location: str) -> DataFrame | None:
    """The table, None if there is none that can be read."""
    try:
        return spark.read.parquet(f"{location}/v{VERSION}")
    except AnalysisException:
        return None


def cached_tags(spark: SparkSession, files: DataFrame, extract: Callable[[DataFrame], DataFrame], location: str, refresh: bool = False) -> DataFrame:
    """Tags of all files; only new or changed ones are extracted, once, and take the place of what the table had of them.

    The folders of changed files are written anew as a whole and swapped in
    (dynamic partition overwrite), so a retried task, a job run twice or two
    writers at a time leave no file twice; of two writers the last one's folder
    stays, and what it lacks is extracted again when it is asked for.  A table
    that can't be read counts as empty; ``refresh`` extracts all files anew.
    """
    known = stored(spark, location)
    todo = files if known is None or refresh else split(files, known)[1]
    todo = durable(todo)
    tags = extract(todo)
    if not todo.isEmpty():
        fresh = durable(tags.join(todo.select(F.col("path").alias("fname"), "modified"), "fname"))
        # a file without tags is a row without a name
        empty = todo.join(fresh.select(F.col("fname").alias("path")).distinct(), "path", "left_anti").select(F.col("path").alias("fname"), "modified")
        rows = fresh.unionByName(empty, allowMissingColumns=True).withColumn("path", F.col("fname")).withColumn("bucket", bucket())
        if known is not None:
            touched = todo.select(bucket().alias("bucket")).distinct()
            kept = known.withColumn("bucket", F.col("bucket").cast("int")).join(F.broadcast(touched), "bucket", "left_semi").join(todo.select("path"), "path", "left_anti")  # BUCKETS rows at most
            rows = durable(rows.unionByName(kept, allowMissingColumns=True))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{location}/v{VERSION}")
    found = stored(spark, location)
    if found is None:
        return tags
    return found.join(files.select("path", "modified"), ["path", "modified"], "left_semi").where("name is not null").drop("path", "modified", "bucket")

"""Places and running sums over a total order without a single-partition window.

Rows are range-partitioned and sorted once and checkpointed; each partition's
count and sum (a few numbers per partition) give the offsets of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import durable


def placed(df: DataFrame, *order: Column, value: Column | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``place`` (from 0 in that order), ``total`` and, for a value, ``running`` (inclusive sum); ``sums`` names further ones.

    The order has to be total for places to be deterministic.
    """
    sums = (sums or {}) | ({} if value is None else {"running": value})
    cells = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cells = durable(cells.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"), *(c.alias(f"__v_{n}") for n, c in sums.items())))
    parts = cells.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a bound that does not grow with the rows
    offsets = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"), *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0.0)).alias(f"__b_{n}") for n in sums), F.sum("__n").over(Window.partitionBy()).alias("total"))
    out = cells.join(F.broadcast(offsets), "__part").withColumn("place", F.col("__off") + F.col("__at"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        out = out.withColumn(n, F.col(f"__b_{n}") + F.sum(f"__v_{n}").over(within))
    return out.drop("__part", "__at", "__off", *(f"__{k}_{n}" for n in sums for k in "vb"))


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")

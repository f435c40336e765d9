"""Carry-forward over ordered rows of any length: a segmented scan instead of a window over a whole segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import durable


def carried(rows: DataFrame, segment: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value that is not null at or before a row in its segment, null before the first.

    Rows are range-partitioned by segment and order, so that a long segment lies
    in many partitions.  Values are carried within each partition's share of a
    segment, and from the last value of each share, one row, to those that
    follow.  The order has to be total within a segment.
    """
    # a struct tells a row without a value from one that has it
    held = F.when(value.isNotNull(), F.struct(value.alias("v")))
    place = [F.col(segment).asc_nulls_first(), F.col(order).asc_nulls_first()]
    cells = durable(rows.withColumn("__held", held).repartitionByRange(*place).withColumn("__part", F.spark_partition_id()))
    share = Window.partitionBy("__part", segment)
    within = share.orderBy(place[1]).rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.withColumn("__in", F.last("__held", ignorenulls=True).over(within))
    # as many rows a segment as it has partitions
    shares = cells.groupBy(F.col("__part").alias("__p"), F.col(segment).alias("__s")).agg(F.max_by("__held", F.when(F.col("__held").isNotNull(), F.col(order))).alias("__last"))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).where("__carry is not null").select("__p", "__s", "__carry")
    out = filled.join(shares, (F.col("__part") == F.col("__p")) & F.col(segment).eqNullSafe(F.col("__s")), "left")
    return out.select(*rows.columns, F.coalesce("__in", "__carry")["v"].alias(name))

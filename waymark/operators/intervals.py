"""Positions and intervals: which intervals hold a position, and which one holds an interval most closely.

Intervals are rows of ``group, start, end`` with whole numbers, both ends
included; a null end is an interval that never closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import durable

#: Sizes of bins are powers of two from 2 ** 0 on; longer intervals than the last are joined by group.
LEVELS = 40
_OPEN = LEVELS


def _level(length):
    """The level whose bins are at least as long as an interval of that many positions."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) - F.lit(1e-9)).cast("int")


def within(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pairs of ``points(group, at, *)`` and ``intervals(group, start, end, *)`` with ``start <= at <= end``.

    An interval lies in two bins at most of the level that fits its length, and
    a point in one bin of each level that occurs, so both sides are multiplied
    by constants whatever the lengths are, and equal bins meet by an equality
    join; the exact test follows.  Rows with a null group, position or start pair
    with nothing; column names other than ``group`` have to differ.
    """
    spans = intervals.where("group is not null and start is not null and (end is null or end >= start)")
    level = F.when(F.col("end").isNull(), _OPEN).otherwise(F.least(_level(F.col("end") - F.col("start") + 1), F.lit(_OPEN)))
    spans = spans.withColumn("__level", level)
    size = F.pow(F.lit(2.0), F.col("__level"))
    bins = lambda at: F.when(F.col("__level") == _OPEN, 0).otherwise(F.floor(at / size)).cast("bigint")
    spans = spans.withColumn("__bin", F.explode(F.array_distinct(F.array(bins(F.col("start")), bins(F.coalesce("end", "start"))))))
    # at most LEVELS + 1 rows
    levels = spans.select("__level").distinct()
    found = points.where("group is not null and at is not null").join(F.broadcast(levels), F.lit(True))
    found = found.withColumn("__bin", bins(F.col("at")))
    return found.join(spans, ["group", "__level", "__bin"]).where("at >= start and (end is null or at <= end)").drop("__level", "__bin")


def outside(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The points that no interval holds, repeated ones included; so are points with a null group or position."""
    held = within(points.select("group", "at").distinct(), intervals.select("group", "start", "end")).select("group", "at").distinct()
    return points.join(held, ["group", "at"], "left_anti")


_STACK = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def nearest(intervals: DataFrame) -> DataFrame:
    """``group, id, parent, depth``: for each of ``intervals(group, start, end, id)`` the smallest other one that holds it, and how many do in all.

    Rows are sorted by start, longer ones first, and each partition runs a stack
    of the intervals that are open.  What is still open where a partition ends
    goes before the rows of each later one that it reaches, so an interval of
    any length, and a group of any size, is spread over partitions; carried rows
    are as many as partitions times the depth.  Of equal intervals that with the
    smaller id holds the other.  Intervals nest or lie apart, as brackets do; where
    two cross, the one that ends first counts as closed where the other begins.
    Ids are whole numbers and differ within a group.  An interval without start is left out.
    """
    last = (1 << 62) - 1
    rows = intervals.where("start is not null").select("group", F.col("start").cast("bigint").alias("start"), F.coalesce(F.col("end").cast("bigint"), F.lit(last)).alias("end"), F.col("id").cast("bigint").alias("id"))
    order = [F.col("group").asc_nulls_first(), F.col("start"), F.desc("end"), F.col("id")]
    cells = durable(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is open where each partition ends."""
        stack, group, part = [], None, None
        for batch in batches:
            for g, start, end, id_, p in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, p) != (group, part):
                    if part is not None and p != part:
                        yield out(stack, group, part)
                    stack, group, part = [], g, p
                while stack and stack[-1][1] < end:
                    stack.pop()
                stack.append((start, end, id_))
        if part is not None:
            yield out(stack, group, part)

    groups = rows.schema["group"].dataType.simpleString()
    names = ["group", "start", "end", "id", "part"]

    def out(stack, group, part):
        columns = [pa.array([group] * len(stack)), *(pa.array([s[i] for s in stack], pa.int64()) for i in range(3)), pa.array([part] * len(stack), pa.int32())]
        return pa.RecordBatch.from_arrays([columns[0].cast(pa.string()) if groups == "string" else columns[0].cast(pa.int64()), *columns[1:]], names)

    if groups not in ("string", "bigint"):
        raise ValueError("groups are strings or bigints")
    sorted_ = lambda df: df.repartition("part").sortWithinPartitions("part", *order)
    ends = durable(sorted_(cells).mapInArrow(opened, f"group {groups}, start bigint, end bigint, id bigint, part int"))
    # where each partition begins: one row each
    begins = cells.groupBy(F.col("part").alias("to")).agg(F.min(F.struct("group", "start")).alias("b"))
    carried = ends.join(F.broadcast(begins), (F.col("to") > F.col("part")) & F.col("group").eqNullSafe(F.col("b.group")) & (F.col("end") >= F.col("b.start")))
    carried = carried.select("group", "start", "end", "id", F.col("to").alias("part"), F.lit(True).alias("carried"))

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, group, part = [], None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            kept, parents, depths = [], [], []
            for i, (g, start, end, id_, p, old) in enumerate(zip(*columns)):
                if (g, p) != (group, part):
                    stack, group, part = [], g, p
                while stack and stack[-1][1] < end:
                    stack.pop()
                if not old:
                    kept.append(i)
                    parents.append(stack[-1][2] if stack else None)
                    depths.append(len(stack))
                stack.append((start, end, id_))
            picked = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(3), pa.array(parents, pa.int64()), pa.array(depths, pa.int64())], ["group", "id", "parent", "depth"])

    whole = cells.withColumn("carried", F.lit(False)).unionByName(carried)
    whole = whole.repartition("part").sortWithinPartitions("part", *order).select(*names, "carried")
    return whole.mapInArrow(resolved, f"group {groups}, id bigint, parent bigint, depth bigint")


def enclosing(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points(group, at, *)`` with ``owner``: the id of the smallest of ``intervals(group, start, end, id)`` around each, null for none.

    Positions count as intervals of their own that hold nothing smaller; their
    ids are negative in ``nearest``, so the intervals' own are at least 0.
    """
    places = points.select("group", "at").where("at is not null").distinct().withColumn("id", -1 - F.monotonically_increasing_id())
    places = durable(places)
    both = intervals.select("group", "start", "end", F.col("id").cast("bigint").alias("id"), F.lit(0).alias("p"))
    # a position comes after the intervals that start there: it is shorter, or its id counts as larger
    found = nearest(_shifted(both, places))
    owners = found.where("id < 0").select("id", F.col("parent").alias("owner")).join(places, "id").drop("id")
    return points.join(owners, (points["at"] == owners["at"]) & points["group"].eqNullSafe(owners["group"]), "left").select(*(points[c] for c in points.columns), "owner")


def _shifted(intervals: DataFrame, places: DataFrame) -> DataFrame:
    """Intervals with room between their ends, and positions within that room."""
    wide = intervals.select("group", (F.col("start").cast("bigint") * 4).alias("start"), (F.col("end").cast("bigint") * 4 + 3).alias("end"), "id")
    return wide.unionByName(places.select("group", (F.col("at").cast("bigint") * 4 + 1).alias("start"), (F.col("at").cast("bigint") * 4 + 1).alias("end"), "id"))

"""Exact set-similarity join: pairs of sets whose Jaccard similarity reaches a threshold, by prefix, length and position.

Elements are ordered by how many sets have them, rare ones first.  Two sets of
similarity ``t`` share an element among the first ``n - ceil(t * n) + 1`` of each
(the prefix), their sizes differ by a factor of ``t`` at most, and from their
first common element on there is room for the overlap that they need.  So an
element that nearly all sets have stands last in each and proposes nothing,
unless sets have hardly any other.  What is proposed is verified by counting.

Sets are rows of ``set, element`` throughout.  Places within a set come from a
range partitioning with offsets, and sizes split the sets of an element into
buckets, so neither a large set nor a common element has to meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.ordering import placed
from waymark.session import durable


def _needed(threshold: float, n: F.Column) -> F.Column:
    """How many elements a set of ``n`` has to share at least; a little slack for the rounding of products."""
    return F.ceil(F.lit(threshold) * n - F.lit(1e-9))


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """``set, element, n, at``: the first elements of each set, in the order of rarity, with the set's size and their place."""
    sizes = rows.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    common = rows.groupBy("element").agg(F.count(F.lit(1)).alias("m"))
    whole = placed(rows.join(common, "element"), F.col("set"), F.col("m"), F.col("element"))
    first = whole.groupBy("set").agg(F.min("place").alias("first"))
    found = whole.join(first.join(sizes, "set"), "set").withColumn("at", F.col("place") - F.col("first"))
    return found.where(F.col("at") <= F.col("n") - _needed(threshold, F.col("n"))).select("set", "element", "n", "at")


def candidates(prefix: DataFrame, threshold: float) -> DataFrame:
    """``a, na, b, nb``: pairs ``a < b`` that a common prefix element proposes and neither size nor place rules out."""
    # sizes within a factor of the threshold lie in the same bucket or in neighbouring ones
    width = math.log(1 / threshold) if threshold < 1 else 1.0
    bucket = F.floor(F.log("n") / F.lit(max(width, 1e-6)) + F.lit(1e-9))
    shared = prefix.join(prefix.groupBy("element").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("element"), "element")
    shared = durable(shared.withColumn("bucket", bucket))
    left = shared.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("at").alias("i"), "element", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"))
    right = shared.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("at").alias("j"), "element", "bucket")
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - F.lit(1e-9))
    met = left.join(right, ["element", "bucket"]).where("a < b")
    met = met.where((F.col("nb") >= _needed(threshold, F.col("na"))) & (F.col("na") >= _needed(threshold, F.col("nb"))))
    # at the pair's first common element nothing lies before; at later ones the bound may fail, which loses nothing
    met = met.where(1 + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1 >= overlap)
    return met.select("a", "na", "b", "nb").distinct()


def similar_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, together, score`` of pairs ``a < b`` of ``rows(set, element)`` with a Jaccard similarity of at least the threshold.

    Repeated rows count once; rows with a null on either side are in no set.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0, at most 1")
    rows = durable(rows.select("set", "element").where("set is not null and element is not null").distinct())
    pairs = durable(candidates(prefixes(rows, threshold), threshold))
    mine = pairs.join(rows.withColumnRenamed("set", "a"), "a")
    both = mine.join(rows.withColumnRenamed("set", "b"), ["b", "element"], "left_semi")
    counted = both.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("together"))
    score = F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))
    return counted.withColumn("score", score).where(F.col("score") >= threshold).select("a", "b", "together", "score")

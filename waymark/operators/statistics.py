"""Distribution statistics of ranks and what they say about confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config
from waymark.operators.ordering import placed


def gini(df: DataFrame, value: str = "rank") -> DataFrame:
    """One row ``n, gini``; 0 for fewer than two values or a sum of 0."""
    rows = placed(df.select(F.col(value).cast("double").alias("x")), F.col("x"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum((F.col("place") + 1) * F.col("x")).alias("w"))
    return got.select("n", F.when((F.col("n") < 2) | (F.col("s") == 0), 0.0).otherwise(2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def entropy(df: DataFrame, value: str = "rank") -> DataFrame:
    """One row ``entropy`` in bits, from sums alone: ``log2 S - sum(x log2 x) / S``."""
    x = F.col(value).cast("double")
    got = df.agg(F.sum(x).alias("s"), F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)).alias("t"))
    return got.select(F.when(F.coalesce("s", F.lit(0.0)) <= 0, 0.0).otherwise(F.log2("s") - F.col("t") / F.col("s")).alias("entropy"))


def percentiles(df: DataFrame, points: tuple[int, ...], value: str = "rank") -> DataFrame:
    """One row with ``p<point>``: the value at place ``min(int(n p / 100), n - 1)``; 0 for no rows."""
    rows = placed(df.select(F.col(value).cast("double").alias("x")), F.col("x"))
    at = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    return rows.agg(*(F.coalesce(F.max(F.when(F.col("place") == at(p), F.col("x"))), F.lit(0.0)).alias(f"p{p}") for p in points))


def upper_median(df: DataFrame, value: str, default: float = 5.0) -> DataFrame:
    """One row ``median``: the value at place ``n // 2`` of those above 0."""
    rows = placed(df.where(F.col(value) > 0).select(F.col(value).cast("double").alias("x")), F.col("x"))
    return rows.agg(F.coalesce(F.max(F.when(F.col("place") == F.floor(F.col("total") / 2), F.col("x"))), F.lit(default)).alias("median"))


def cliff(df: DataFrame, value: str = "rank", drop: float = 0.5) -> DataFrame:
    """One row ``cliff``: the percentile of the first value below ``drop`` of the one before it, null below ten rows."""
    rows = placed(df.select(F.col(value).cast("double").alias("x")), F.col("x").desc())
    following = rows.select((F.col("place") + 1).alias("place"), F.col("x").alias("before"))
    first = rows.join(following, "place").where((F.col("before") > 0) & (F.col("x") / F.col("before") < drop)).agg(F.min(F.struct("place", "total")).alias("m"))
    return first.select(F.when(F.col("m.total") >= 10, F.floor(100 * F.col("m.place") / F.col("m.total"))).cast("bigint").alias("cliff"))


def bimodal(n: Column, p10: Column, p50: Column, p90: Column, config: Config = DEFAULT) -> Column:
    """X09."""
    return (n >= 10) & (p50 != 0) & (p50 - p10 > 0) & ((p90 - p50) / F.nullif(p50 - p10, F.lit(0.0)) > config.bimodality)


def confidence(df: DataFrame, value: str = "rank", *, orphans: int = 0, symbols: int = 0, config: Config = DEFAULT) -> DataFrame:
    """One row ``n, gini, entropy, stability, patterns, level``."""
    rows = placed(df.select(F.col(value).cast("double").alias("x")), F.col("x"))
    x, n, at = F.col("x"), F.col("total"), F.col("place")
    pick = lambda p: F.coalesce(F.max(F.when(at == F.least(F.floor(n * p / 100), n - 1), x)), F.lit(0.0)).alias(f"p{p}")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum((at + 1) * x).alias("w"), F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)).alias("t"), pick(10), pick(50), pick(90))
    n, s = F.col("n"), F.col("s")
    got = got.withColumn("gini", F.when((n < 2) | (F.coalesce(s, F.lit(0.0)) == 0), 0.0).otherwise(2 * F.col("w") / (n * s) - (n + 1) / n))
    got = got.withColumn("entropy", F.when(F.coalesce(s, F.lit(0.0)) <= 0, 0.0).otherwise(F.log2(s) - F.col("t") / s))
    found = F.array_compact(F.array(F.when(F.col("gini") < config.gini_diffuse, "diffuse"), F.when(bimodal(n, F.col("p10"), F.col("p50"), F.col("p90"), config), "fragmented"), F.lit("sparse") if symbols and orphans / symbols > config.orphan_share else F.lit(None).cast("string")))
    got = got.withColumn("patterns", F.when(n < 3, F.array(F.lit("insufficient_data"))).otherwise(found))
    p = F.col("patterns")
    high = (F.col("gini") >= config.gini_high) & (F.col("entropy") < config.entropy_high) & ((F.size(p) == 0) | ((F.size(p) == 1) & F.array_contains(p, "fragmented")))
    level = F.when(n < 3, "low").when(high, "high").when((F.size(p) >= 2) | F.array_contains(p, "diffuse"), "low").otherwise("medium")
    return got.select("n", "gini", "entropy", F.least(F.col("gini") / config.gini_high, F.lit(1.0)).alias("stability"), "patterns", level.alias("level"))


def summary(df: DataFrame, value: str = "rank") -> DataFrame:
    """One row ``lowest, p50, p90, highest``."""
    rows = placed(df.select(F.col(value).cast("double").alias("x")), F.col("x"))
    at = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    return rows.agg(F.min("x").alias("lowest"), *(F.max(F.when(F.col("place") == at(p), F.col("x"))).alias(f"p{p}") for p in (50, 90)), F.max("x").alias("highest"))

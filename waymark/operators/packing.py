"""How many ranked rows, in what detail, fit a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, HIGH, LOW, MEDIUM, Config
from waymark.functions import scoring
from waymark.operators.ordering import placed


def prefix(df: DataFrame, budget: float, cost: Column, *order: Column) -> DataFrame:
    """The longest prefix in that order whose summed cost is within the budget, with ``place`` and ``running``."""
    return placed(df, *order, value=cost).where(F.col("running") <= budget)


def best_config(options: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Of ``tags, detail`` rows that of the highest score (X10), the earlier detail on a tie."""
    scored = options.withColumn("score", scoring.config_score(F.col("tags"), F.col("detail"), config))
    return scored.orderBy(F.desc("score"), "detail").limit(1)


def fit_details(df: DataFrame, budget: float, costs: dict[int, Column], *order: Column, config: Config = DEFAULT) -> DataFrame:
    """``detail, tags, cost``: the largest prefix of each detail level that fits by estimated cost, best first."""
    out = None
    for detail, cost in costs.items():
        got = prefix(df, budget, cost, *order).agg(F.count(F.lit(1)).alias("tags"), F.max("running").alias("cost")).select(F.lit(detail).alias("detail"), "tags", "cost").where("tags > 0")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("score", scoring.config_score(F.col("tags"), F.col("detail"), config)).orderBy(F.desc("score"), "detail")


def sizes(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place`` and ``size_1`` to ``size_3``: about how many characters the directory of each prefix has.

    A row adds what it shows, nothing if its parent is no class of its file; the
    first of its file adds the file's line, the first of its list (a class's
    methods, a file's functions) that list's heading.  Firsts are minima over
    their keys, sums one prefix scan for all details.
    """
    ranked = placed(rows, *order).drop("total")
    owners = ranked.where("node_type = 'class'").select(F.col("rel_fname").alias("__f"), F.col("name").alias("__c")).distinct()
    ranked = ranked.join(owners, (F.col("rel_fname") == F.col("__f")) & (F.col("parent_name") == F.col("__c")), "left").withColumn("__shown", (F.col("node_type") == "class") | F.col("parent_name").isNull() | F.col("__c").isNotNull()).drop("__f", "__c")
    is_class = F.col("node_type") == "class"
    heading = F.when(~is_class & F.col("__shown"), F.struct("rel_fname", F.when(F.col("node_type").isin("constant", "variable"), "const").otherwise("def").alias("list"), "parent_name"))
    keyed = ranked.withColumns({"__file": F.struct("rel_fname"), "__list": heading})
    first = lambda key: keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("place").alias("place")).select("place", F.lit(True).alias(f"{key}_first"))
    marked = keyed.join(first("__file"), "place", "left").join(first("__list"), "place", "left")
    new_file = F.when(F.col("__file_first"), F.length("rel_fname") + 2).otherwise(0)
    new_list = F.when(F.col("__list_first"), F.when(F.col("parent_name").isNull(), 6).otherwise(8)).otherwise(0)
    added = lambda d: (F.when(F.col("__shown"), F.length(F.col(f"shown_{d}")) + F.when(is_class, 10).otherwise(2)).otherwise(0) + new_file + new_list).cast("double")
    return placed(marked, F.col("place"), sums={f"size_{d}": added(d) for d in (LOW, MEDIUM, HIGH)}).drop("__file", "__list", "__file_first", "__list_first", "__shown", "total")


def guesses(sized: DataFrame, budget: int, characters: float = 4.0) -> dict[int, int]:
    """How many rows fit a budget of tokens by estimate, for each detail."""
    got = sized.agg(*(F.count_if(F.col(f"size_{d}") <= budget * characters).alias(str(d)) for d in (LOW, MEDIUM, HIGH))).first()
    return {d: got[str(d)] for d in (LOW, MEDIUM, HIGH)}


def pack(head: list, budget: int, render: Callable[[list, int], str], count: Callable[[str], int], config: Config = DEFAULT, guess: dict[int, int] | None = None) -> tuple[int, int, str, int]:
    """The exact choice over rendered text: ``(tags, detail, text, tokens)`` of the best configuration.

    ``head`` is the ranked prefix that can fit at all.  With a ``guess`` of the
    tags for each detail only prefixes around it are rendered; the choice is the
    same.  ValueError if nothing fits.
    """
    best = None
    for detail in (LOW, MEDIUM, HIGH):
        low, high, fits = 1, len(head), None
        at, step, before = (max(1, min(len(head), guess.get(detail, 1))) if guess else None), 1, None
        while low <= high:
            middle = (low + high) // 2 if at is None else at
            text = render(head[:middle], detail)
            size = count(text) if text else None
            if size is not None and size <= budget:
                fits, low = (middle, detail, text, size), middle + 1
                up = True
            else:
                high, up = middle - 1, False
            if at is not None:
                # further and further from the guess, until the boundary lies between two trials
                turned, before = before is not None and up != before, up
                at, step = middle + step if up else middle - step, step * 2
                if turned or not low <= at <= high:
                    at = None
        value = lambda c: c[0] * config.coverage_weight + c[1] * config.detail_weight
        if fits and (best is None or value(fits) > value(best)):
            best = fits
    if best is None:
        raise ValueError("nothing fits the budget")
    return best

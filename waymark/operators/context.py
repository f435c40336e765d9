"""Focus, boosts, search: how a request re-weighs ranked tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config
from waymark.functions import scoring, text
from waymark.session import durable


#: Targets of a request beyond which they go by table instead of as constants.
CONSTANTS = 32


def focus_matches(names: DataFrame, targets: DataFrame) -> DataFrame:
    """F08 for many: pairs of ``targets(target)`` and ``names(name)`` with ``text.matches_query``.

    An inverted index of each name's parts, letter runs and grams of up to three
    letters meets the targets' terms by equality.  A target that has to be
    within a name, or whose parts have to be all among the name's, is looked up
    by its rarest term only, and tested on what that gives.
    """
    names = durable(names.select("name").where("name is not null").distinct())
    targets = targets.select("target").where(F.trim("target") != "").distinct()
    low, wanted = F.lower("name"), F.lower("target")
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.concat(F.lit("g"), F.substring(c, i, n)))
    letter = lambda lead, values: F.transform(values, lambda v: F.concat(F.lit(lead), v))
    terms = F.concat(letter("p", text.name_parts(F.col("name"))), letter("r", text.letter_runs(F.col("name"))), grams(low, 1), grams(low, 2), grams(low, 3))
    index = durable(names.select("name", F.explode(F.array_distinct(terms)).alias("term")))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("names"))
    parts = text.name_parts(F.col("target"))
    three = F.least(F.length(wanted), F.lit(3))
    asked = targets.select("target", F.explode(F.array_distinct(F.concat(letter("p", parts), letter("r", parts), F.transform(F.sequence(F.lit(1), F.length(wanted) - three + 1), lambda i: F.concat(F.lit("g"), F.substring(wanted, i, three)))))).alias("term"))
    asked = durable(asked.join(counts, "term", "left").withColumn("kind", F.substring("term", 1, 1)))
    # a term that no name has rules its kind out
    rarest = asked.where("kind <> 'r'").groupBy("target", "kind").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("n"), "term")).alias("t")).where("t.n > 0").select("target", F.col("t.term").alias("term"))
    tested = rarest.join(index, "term").where(text.matches_query(F.col("name"), F.col("target"))).select("target", "name")
    runs = asked.where("kind = 'r' and names > 0").select("target", "term").join(index, "term").select("target", "name")
    return tested.unionByName(runs).distinct()


def resolve_targets(tags: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G14 for a table of ``targets(target)``: ``target, file`` and ``target, name``.

    A target that is a file of ``tags`` stands for that file, any other is a
    query on the names of definitions.
    """
    targets = durable(targets.select("target").where(F.trim("target") != "").distinct())
    paths = tags.select("rel_fname", F.explode(F.array("rel_fname", "fname")).alias("target")).distinct()
    as_files = durable(targets.join(paths, "target").select("target", F.col("rel_fname").alias("file")))
    queries = targets.join(as_files.select("target").distinct(), "target", "left_anti")
    defined = tags.where("kind = 'def'").select("name", "rel_fname").distinct()
    named = durable(focus_matches(defined.select("name"), queries))
    files = as_files.unionByName(named.join(defined, "name").select("target", F.col("rel_fname").alias("file"))).distinct()
    return files, named


def resolve_focus(tags: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """``file`` rows and ``name`` rows that the targets mean.

    A short list goes into the plan as constants, a longer one as a table.
    """
    targets = [t for t in targets if t.strip()]
    if not targets:
        return tags.select(F.col("rel_fname").alias("file")).where("false"), tags.select("name").where("false")
    if len(targets) > CONSTANTS:
        found, named = resolve_targets(tags, tags.sparkSession.createDataFrame([(t,) for t in targets], "target string"))
        return found.select("file").distinct(), named.select("name").distinct()
    is_file = F.col("rel_fname").isin(targets) | F.col("fname").isin(targets)
    paths_met = {x for r in tags.where(is_file).select("rel_fname", "fname").distinct().collect() for x in r}  # at most one row a target
    queries = [t for t in targets if t not in paths_met]
    by_name = reduce(lambda a, b: a | b, (text.matches_query(F.col("name"), F.lit(q)) for q in queries)) if queries else F.lit(False)
    named = tags.where((F.col("kind") == "def") & by_name)
    files = tags.where(is_file).select("rel_fname").unionByName(named.select("rel_fname")).distinct()
    return files.select(F.col("rel_fname").alias("file")), named.select("name").distinct()


def _mark(df: DataFrame, other: DataFrame, left: str, right: str, name: str) -> DataFrame:
    keys = other.select(F.col(right).alias("__k")).distinct().withColumn(name, F.lit(True))
    return df.join(keys, F.col(left) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(False)))


def boosted(tags: DataFrame, file_ranks: DataFrame, symbol_ranks: DataFrame | None = None, *, idents: DataFrame, files: DataFrame, focus: DataFrame, mates: DataFrame, weights: DataFrame | None = None, caller_files: DataFrame | None = None, bias: float = 1.0, exclude_unranked: bool = False, config: Config = DEFAULT) -> DataFrame:
    """Tags with ``base, boost, weight, caller, rank``.

    ``idents(name)``, ``files(file)``, ``focus(file)`` and ``mates(file)`` mark
    rows; ``weights(file, weight)`` comes from history; files of ``caller_files``
    are multiplied by ``bias``.
    """
    out = tags.join(file_ranks.select(F.col("file").alias("__f"), "file_rank"), F.col("rel_fname") == F.col("__f"), "left").drop("__f")
    if exclude_unranked:
        out = out.where(F.coalesce("file_rank", F.lit(0.0)) > config.unranked)
    if symbol_ranks is not None:
        ranks = symbol_ranks.select(F.col("file").alias("__f"), F.col("symbol").alias("__s"), F.col("rank").alias("__r"))
        out = out.join(ranks, (F.col("rel_fname") == F.col("__f")) & (F.col("name") == F.col("__s")), "left").drop("__f", "__s")
    else:
        out = out.withColumn("__r", F.lit(None).cast("double"))
    out = out.withColumn("base", F.coalesce("__r", "file_rank", F.lit(0.0))).drop("__r")
    for other, left, right, name in ((idents, "name", "name", "is_ident"), (files, "rel_fname", "file", "is_file"), (focus, "rel_fname", "file", "is_focus"), (mates, "rel_fname", "file", "is_mate")):
        out = _mark(out, other, left, right, name)
    out = out.withColumn("boost", scoring.contextual_boost(F.col("is_ident"), F.col("is_file"), F.col("is_focus"), F.col("is_mate"), config))
    if weights is not None:
        out = out.join(weights.select(F.col("file").alias("__f"), "weight"), F.col("rel_fname") == F.col("__f"), "left").drop("__f").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        out = out.withColumn("weight", F.lit(1.0))
    if caller_files is not None:
        out = _mark(out, caller_files, "rel_fname", "file", "__c").withColumn("caller", F.when(F.col("__c"), bias).otherwise(1.0)).drop("__c")
    else:
        out = out.withColumn("caller", F.lit(1.0))
    return out.withColumn("rank", F.col("base") * F.col("boost") * F.col("weight") * F.col("caller"))


def by_rank() -> list[Column]:
    """A total order, ties by place in the code."""
    return [F.desc("rank"), F.col("rel_fname"), F.col("line"), F.col("name")]


def search(tags: DataFrame, query: str, *, definitions: bool = True, references: bool = True, limit: int = 50) -> DataFrame:
    """Definitions first, then by the place of the match."""
    kinds = [k for k, wanted in (("def", definitions), ("ref", references)) if wanted]
    hits = tags.where(F.lower("name").contains(query.lower()) & F.col("kind").isin(kinds)) if kinds and query else tags.where("false")
    return hits.orderBy(F.col("kind") != "def", text.position(F.col("name"), query), "rel_fname", "line", "name").limit(limit)


def search_context(hits: DataFrame, files: DataFrame, context: int = 2) -> DataFrame:
    """Hits with the numbered lines around them; hits without any drop out.

    The lines are cut out of the text where it meets its hit; the hits' order stays.
    """
    wanted = hits.withColumn("__i", F.monotonically_increasing_id()).groupBy("rel_fname", "line", "name", "kind").agg(F.min("__i").alias("__i"))
    met = wanted.join(files.where("text is not null").select(F.col("rel").alias("rel_fname"), "text"), "rel_fname")
    lines, first = F.split("text", "\n"), F.greatest(F.col("line") - context, F.lit(1))
    near = F.when(first <= F.size(lines), F.slice(lines, first, F.greatest(F.col("line") + context - first + 1, F.lit(0))))
    shown = F.transform(near, lambda x, i: F.format_string("%4d: %s", first + i, x))
    return met.where(F.size(near) > 0).orderBy("__i").select("rel_fname", "line", "name", "kind", F.array_join(shown, "\n").alias("context"))

"""Change history: file statistics, weights, badges, phases, coupling, stories.

``history(commit_id, ts, author, file)`` has a row for each file of each commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config
from waymark.functions import scoring
from waymark.operators import similarity, statistics
from waymark.operators.ordering import top_per_group
from waymark.session import durable


def horizon(history: DataFrame, commits: int) -> DataFrame:
    """The rows of the latest ``commits`` commits."""
    last = history.groupBy("commit_id").agg(F.max("ts").alias("__ts")).orderBy(F.desc("__ts"), "commit_id").limit(commits)
    return history.join(last.select("commit_id"), "commit_id", "left_semi")


def file_stats(history: DataFrame) -> DataFrame:
    """``file, commits, first_seen, last_modified, authors``."""
    return history.groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_modified"), F.sort_array(F.collect_set("author")).alias("authors"))


def file_weights(stats: DataFrame, now: Column, *, recency: float = 1.0, churn: float = 1.0, author: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """``file, age, commits, weight``."""
    age = scoring.elapsed_days(now, F.col("last_modified"))
    own = None if author is None else F.array_contains("authors", author)
    return stats.select("file", age.alias("age"), "commits", scoring.git_weight(age, F.col("commits"), recency, churn, own, config).alias("weight"))


def file_badges(stats: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """``file, badges``."""
    return stats.select("file", scoring.badges(scoring.elapsed_days(now, F.col("last_modified")), F.col("commits"), config).alias("badges"))


def file_phases(stats: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """``file, age, quiet, commits, phase`` against the upper median of commits."""
    middle = statistics.upper_median(stats, "commits")
    age, quiet = scoring.elapsed_days(now, F.col("first_seen")), scoring.elapsed_days(now, F.col("last_modified"))
    rows = stats.crossJoin(F.broadcast(middle))  # one row
    return rows.select("file", age.alias("age"), quiet.alias("quiet"), "commits", scoring.phase(age, quiet, F.col("commits"), F.col("median"), config).alias("phase"))


def boosted(weights: DataFrame, n: int = 10) -> DataFrame:
    """The highest weights above 1."""
    return weights.where("weight > 1").orderBy(F.desc("weight"), "file").limit(n)


def commit_sizes(touches: DataFrame) -> DataFrame:
    """``commit_id, size``."""
    return touches.groupBy("commit_id").agg(F.countDistinct("file").alias("size"))


#: Pairs within commits, as a multiple of the touches, beyond which coupling prunes.
DENSE = 16


def coupling(touches: DataFrame, *, threshold: float | None = None, largest_commit: int | None = None, pruned: bool | None = None, config: Config = DEFAULT) -> DataFrame:
    """``a, b, together, score`` (Jaccard) for pairs ``a < b`` at or above the threshold.

    Pairs come from the commits that files share.  Where commits are so wide that
    their pairs would be many times the touches, and always with ``pruned``, a
    set-similarity join finds the same pairs without them.  ``largest_commit``
    leaves out wider commits altogether (off unless asked for).
    """
    threshold = config.coupling if threshold is None else threshold
    rows = touches.select("commit_id", "file").distinct()
    if largest_commit:
        rows = rows.join(commit_sizes(rows).where(F.col("size") <= largest_commit), "commit_id", "left_semi")
    if pruned is None:
        rows = durable(rows)
        wide = rows.groupBy("commit_id").agg(F.count(F.lit(1)).cast("double").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum("m").alias("touches")).first()
        pruned = threshold > 0 and (wide["pairs"] or 0) > DENSE * (wide["touches"] or 0)
    if pruned:
        return similarity.similar_sets(rows.select(F.col("file").alias("set"), F.col("commit_id").alias("element")), threshold)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    sets = rows.groupBy("commit_id").agg(F.sort_array(F.collect_set("file")).alias("files")).where("size(files) > 1")
    pairs = sets.select(F.posexplode("files").alias("at", "a"), "files").select("a", F.explode(F.expr("slice(files, at + 2, size(files))")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    scored = pairs.join(sizes.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    scored = scored.withColumn("score", F.col("together") / (F.col("na") + F.col("nb") - F.col("together")))
    return scored.where(F.col("score") >= threshold).select("a", "b", "together", "score")


def coupling_lists(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """``file, mates array<struct<mate, score>>`` by falling score, empty for files without any."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("mate"), "score"), F.struct(F.col("b").alias("file"), F.col("a").alias("mate"), "score"))).alias("e")).select("e.*")
    lists = both.groupBy("file").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "mate", "score"))).alias("m"))
    empty = F.array().cast("array<struct<mate:string,score:double>>")
    return files.select("file").join(lists, "file", "left").select("file", F.coalesce(F.transform("m", lambda x: F.struct(x["mate"].cast("string").alias("mate"), x["score"].alias("score"))), empty).alias("mates"))


def mates(focus: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files coupled to a focus file that are no focus files themselves."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("mate")), F.struct(F.col("b").alias("file"), F.col("a").alias("mate")))).alias("e")).select("e.*")
    return both.join(focus.select("file"), "file", "left_semi").select(F.col("mate").alias("file")).distinct().join(focus.select("file"), "file", "left_anti")


def coupling_summary(pairs: DataFrame) -> DataFrame:
    """One row ``files, pairs``."""
    return pairs.select(F.explode(F.array("a", "b")).alias("f")).agg(F.countDistinct("f").alias("files"), (F.count(F.lit(1)) / 2).cast("bigint").alias("pairs"))


def stories(history: DataFrame, key: str = "file", recent: int = 10) -> DataFrame:
    """``key, commits, first, last, created_by, primary_author, authors map, recent`` of each key."""
    counts = history.groupBy(key, "author").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("since"))
    people = counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("author", "n")))).alias("authors"), F.min(F.struct((-F.col("n")).alias("k"), "since", "author"))["author"].alias("primary_author"))
    whole = history.groupBy(key).agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min(F.struct("ts", "commit_id", "author"))["author"].alias("created_by"))
    latest = top_per_group(history, [key], recent, F.desc("ts"), F.col("commit_id")).groupBy(key).agg(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "commit_id", "author")))).alias("recent"))
    return whole.join(people, key).join(latest, key)

"""Reference graphs: edges, degrees, PageRank, betweenness, bridges, surfaces, callers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config
from waymark.functions import paths, scoring
from waymark.operators.ordering import top_per_group
from waymark.session import durable


def definitions(tags: DataFrame) -> DataFrame:
    """F01."""
    return tags.where("kind = 'def'")


def references(tags: DataFrame) -> DataFrame:
    return tags.where("kind = 'ref'")


def file_edges(tags: DataFrame) -> DataFrame:
    """``src, dst, weight``, a unit for each distinct (referring file, defining file, name)."""
    refs = references(tags).select("name", F.col("rel_fname").alias("src")).distinct()
    defs = definitions(tags).select("name", F.col("rel_fname").alias("dst")).distinct()
    return refs.join(defs, "name").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def symbol_edges(tags: DataFrame) -> DataFrame:
    """``src_file, src_sym, dst_file, dst_sym, n`` with bag semantics as multiplicity ``n``.

    References whose scope is no definition of their file drop out (F15).  Both
    sides are counted before the join, so duplicates multiply without being
    expanded.
    """
    defs = definitions(tags).groupBy("rel_fname", "name").agg(F.count(F.lit(1)).alias("d"))
    refs = references(tags).where("parent_name is not null").groupBy("rel_fname", "parent_name", "name").agg(F.count(F.lit(1)).alias("r"))
    known = defs.select(F.col("rel_fname").alias("f"), F.col("name").alias("s"))
    refs = refs.join(known, (F.col("rel_fname") == F.col("f")) & (F.col("parent_name") == F.col("s")), "left_semi")
    sources = refs.select(F.col("rel_fname").alias("src_file"), F.col("parent_name").alias("src_sym"), "name", "r")
    targets = defs.select(F.col("rel_fname").alias("dst_file"), "name", "d")
    met = sources.join(targets, "name").where("src_file <> dst_file or src_sym <> name")
    return met.groupBy("src_file", "src_sym", "dst_file", F.col("name").alias("dst_sym")).agg(F.sum(F.col("r") * F.col("d")).alias("n"))


def collapse(edges: DataFrame) -> DataFrame:
    """Symbol edges as file edges without loops."""
    return edges.where("src_file <> dst_file").groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.sum("n").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``id, in_degree, out_degree``; parallel edges count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).cast("bigint").alias("i"), F.col(weight).cast("bigint").alias("o")), F.struct(F.col("dst").alias("id"), F.col(weight).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("o")))).alias("e")).select("e.*")
    return nodes.select("id").join(ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")), "id", "left").na.fill(0)


def hubs(degree: DataFrame, n: int = 10, keep_zero: bool = False) -> DataFrame:
    """A04."""
    return (degree if keep_zero else degree.where("in_degree > 0")).orderBy(F.desc("in_degree"), "id").limit(n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing refers to."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def density(n_nodes: Column, n_edges: Column) -> Column:
    """A07; one for a single node."""
    return F.when(n_nodes > 1, n_edges / (n_nodes * (n_nodes - 1))).otherwise(1.0)


def personalization(nodes: DataFrame, path: Column, focus: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """``id, weight``."""
    weight = paths.depth_weight(path, config)
    if focus:
        weight = weight * F.when(path.isin(*focus), config.focus_multiplier).otherwise(1.0)
    return nodes.select("id", weight.alias("weight"))


def pagerank(weights: DataFrame, edges: DataFrame, *, iterations: int | None = None, config: Config = DEFAULT, cut: int = 5) -> DataFrame:
    """``id, rank`` of personalised PageRank.

    ``weights(id, weight)`` names all vertices; ``edges(src, dst, weight)``.
    Ranks start even, dangling mass goes out by the personalisation, and the
    loop ends when ranks change by less than ``N * tolerance`` in all (tested
    every ``cut`` rounds, where lineage is cut, too) or after ``iterations``.
    """
    edges = durable(edges.select("src", "dst", "weight"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = durable(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))

    def flow(ranks: DataFrame) -> DataFrame:
        sent = steps.join(ranks.select(F.col("id").alias("src"), "rank"), "src")
        return sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))

    return iterated(weights, out.select(F.col("src").alias("id")), flow, iterations=iterations, config=config, cut=cut)


def iterated(weights: DataFrame, senders: DataFrame, flow: Callable[[DataFrame], DataFrame], *, iterations: int | None = None, config: Config = DEFAULT, cut: int = 5) -> DataFrame:
    """PageRank's loop over ``flow(ranks)``, which gives ``id, flow`` from ``id, rank`` and the further columns of ``senders``.

    The rank of vertices that are no ``senders(id)`` goes out by the personalisation.
    """
    more = [c for c in senders.columns if c != "id"]
    weights = durable(weights.select("id", "weight"))
    total = weights.agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n, s = total["n"], total["s"]
    if not n:
        return weights.select("id", F.lit(0.0).alias("rank"))
    base = weights.join(senders.select("id", *more, F.lit(False).alias("stuck")), "id", "left").select("id", *more, (F.col("weight") / s).alias("q"), F.coalesce("stuck", F.lit(True)).alias("stuck"))
    ranks = durable(base.withColumn("rank", F.lit(1.0 / n)))
    dangling = not ranks.where("stuck").isEmpty()
    a, before, limit = config.alpha, ranks, iterations or config.max_iterations
    for round_ in range(1, limit + 1):
        teleport = F.lit(1 - a) * F.col("q")
        following = ranks.drop("rank").join(flow(ranks.select("id", "rank", *more)), "id", "left")
        if dangling:
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("stuck"), F.col("rank"))), F.lit(0.0)).alias("lost"))
            following = following.crossJoin(F.broadcast(lost))  # one row
            teleport = teleport + F.lit(a) * F.col("lost") * F.col("q")
        ranks = following.select("id", *more, "q", "stuck", (F.lit(a) * F.coalesce("flow", F.lit(0.0)) + teleport).alias("rank"))
        if round_ % cut == 0 or round_ == limit:
            last = durable(ranks)
            if iterations is None:
                # the change over several rounds bounds the last one's from above
                change = last.join(before.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if change < n * config.tolerance:
                    ranks = last
                    break
            ranks = before = last
    return ranks.select("id", "rank")


def symbol_pagerank(edges: DataFrame, *, iterations: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """``file, symbol, rank`` over symbol edges."""
    key = lambda f, s: F.to_json(F.struct(F.col(f).alias("f"), F.col(s).alias("s")))
    plain = edges.select(key("src_file", "src_sym").alias("src"), key("dst_file", "dst_sym").alias("dst"), F.col("n").alias("weight"))
    nodes = vertices(plain)
    ranks = pagerank(personalization(nodes, F.get_json_object("id", "$.f"), config=config), plain, iterations=iterations, config=config)
    return ranks.select(F.get_json_object("id", "$.f").alias("file"), F.get_json_object("id", "$.s").alias("symbol"), "rank")


def file_ranks(symbol_ranks: DataFrame) -> DataFrame:
    """A file's rank is that of its best symbol."""
    return symbol_ranks.groupBy("file").agg(F.max("rank").alias("file_rank"))


def betweenness(edges: DataFrame, *, seed: int = 42, config: Config = DEFAULT) -> DataFrame:
    """``id, betweenness`` of the directed graph, normalised.

    Exact for up to ``exact_betweenness`` vertices, else from
    ``betweenness_samples`` sources, chosen by a seeded hash.  All sources'
    frontiers advance as joins, one level at a time, and their shares come back
    the same way.
    """
    edges = durable(edges.select("src", "dst").distinct())
    nodes = durable(vertices(edges))
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    exact = n <= config.exact_betweenness
    sources = nodes if exact else nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(config.betweenness_samples)
    k = n if exact else min(n, config.betweenness_samples)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * n / k
    shares = _frontier_shares(edges, sources)
    found = shares.groupBy("id").agg(F.sum("share").alias("share"))
    return nodes.join(found, "id", "left").select("id", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


def betweenness_summary(found: DataFrame) -> DataFrame:
    """One row ``highest, mean, zeros``."""
    return found.agg(F.max("betweenness").alias("highest"), F.avg("betweenness").alias("mean"), F.count_if(F.col("betweenness") == 0).alias("zeros"))


def _frontier_shares(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Brandes as joins: one level of all sources' searches at a time, then back."""
    seen = durable(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("k")))
    levels = [seen]
    while True:
        reached = levels[-1].join(edges, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("k").alias("k"), (F.first("d") + 1).alias("d"))
        level = durable(reached.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", "d", "k"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = durable(seen.unionByName(level))
    share = levels[-1].select("s", "v", "k", F.lit(0.0).alias("share"))
    out = share
    for level in reversed(levels[:-1]):
        below = share.select("s", F.col("v").alias("w"), F.col("k").alias("kw"), F.col("share").alias("sw"))
        back = level.join(edges, F.col("v") == F.col("src")).join(below, (level["s"] == below["s"]) & (F.col("dst") == F.col("w"))).groupBy(level["s"], "v").agg(F.sum(F.col("k") / F.col("kw") * (1 + F.col("sw"))).alias("share"))
        share = durable(level.join(back, ["s", "v"], "left").select("s", "v", "k", F.coalesce("share", F.lit(0.0)).alias("share")))
        out = out.unionByName(share)
    return out.where("s <> v").select(F.col("v").alias("id"), "share")


def neighbours(edges: DataFrame, n: int = 2) -> DataFrame:
    """``id, connects``: the ``n`` neighbours (either direction) of highest degree."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*").where("id <> other").distinct()
    degree = degrees(vertices(edges), edges).select(F.col("id").alias("other"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    top = top_per_group(both.join(degree, "other"), ["id"], n, F.desc("degree"), F.col("other"))
    return top.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "other"))), lambda x: x["other"]).alias("connects"))


def bridges(edges: DataFrame, n: int | None = None, *, config: Config = DEFAULT, seed: int = 42) -> DataFrame:
    """The top ``n`` by betweenness above 0 with two neighbours each, blank where there are fewer."""
    top = betweenness(edges, seed=seed, config=config).orderBy(F.desc("betweenness"), "id").limit(n or config.bridges).where("betweenness > 0")
    return top.join(neighbours(edges), "id", "left").select("id", "betweenness", F.when(F.size("connects") >= 2, F.col("connects")).otherwise(F.array(F.lit(""), F.lit(""))).alias("connects"))


def surface(edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Distinct calling symbols from outside and inside of each symbol's file, and the label."""
    calls = edges.groupBy("dst_file", "dst_sym", "src_file", "src_sym").agg(F.lit(1).alias("one"))
    counted = calls.groupBy("dst_file", "dst_sym").agg(F.count_if(F.col("src_file") != F.col("dst_file")).alias("external"), F.count_if(F.col("src_file") == F.col("dst_file")).alias("internal"))
    return counted.select(F.col("dst_file").alias("file"), F.col("dst_sym").alias("symbol"), "external", "internal", scoring.surface_label(F.col("external"), F.col("internal"), config).alias("label"))


def surface_totals(labelled: DataFrame) -> DataFrame:
    """A27."""
    counted = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("label", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # one row


def callers(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """``file``: where symbols of ``focus(file, symbol)`` are referred to."""
    hit = edges.join(focus.select(F.col("file").alias("dst_file"), F.col("symbol").alias("dst_sym")), ["dst_file", "dst_sym"], "left_semi")
    return hit.select(F.col("src_file").alias("file")).distinct()

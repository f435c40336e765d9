"""Reference graphs kept as two relations, references to names and definitions of names, without an edge table.

A name that every file refers to and many files define would make an edge for
each pair of them.  Here a name is a vertex between both: ``refs(src, name, r)``
and ``defs(dst, name, d)`` stand for edges of weight ``r * d`` from each ``src``
to each ``dst`` with the same name, loops left out.  Sums over the edges are sums
over the references to a name times sums over its definitions; the loops, which
are the pairs that have one id on both sides, are taken off again.  All relations
here are linear in the tags; names are summed before they meet their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config
from waymark.operators import graph
from waymark.session import durable

#: Names whose pairs ``edge_count`` counts by sets instead of listing them; there are at most ``2 ** HOT`` kinds of files then.
HOT = 12


@dataclass(frozen=True)
class Factors:
    """``refs(src, name, r)``, ``defs(dst, name, d)`` and ``loops(id, name, w)``: the weight of pairs that would be loops."""

    refs: DataFrame
    defs: DataFrame
    loops: DataFrame

    @classmethod
    def of(cls, refs: DataFrame, defs: DataFrame) -> Factors:
        refs, defs = durable(refs), durable(defs)
        loops = refs.withColumnRenamed("src", "id").join(defs.withColumnRenamed("dst", "id"), ["id", "name"]).select("id", "name", (F.col("r") * F.col("d")).alias("w"))
        return cls(refs, defs, durable(loops))


def file_factors(tags: DataFrame) -> Factors:
    """A unit for each distinct file and name on either side."""
    one = F.lit(1).cast("bigint")
    refs = graph.references(tags).where("name is not null").select(F.col("rel_fname").alias("src"), "name").distinct().withColumn("r", one)
    defs = graph.definitions(tags).where("name is not null").select(F.col("rel_fname").alias("dst"), "name").distinct().withColumn("d", one)
    return Factors.of(refs, defs)


def symbol_id(file: str | Column, symbol: str | Column) -> Column:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.to_json(F.struct(column(file).alias("f"), column(symbol).alias("s")))


def symbol_factors(tags: DataFrame) -> Factors:
    """From the symbol around a reference to the symbols of its name, with their multiplicities.

    References whose scope is no definition of their file drop out (F15).
    """
    defs = graph.definitions(tags).groupBy("rel_fname", "name").agg(F.count(F.lit(1)).alias("d"))
    refs = graph.references(tags).where("parent_name is not null").groupBy("rel_fname", "parent_name", "name").agg(F.count(F.lit(1)).alias("r"))
    known = defs.select("rel_fname", F.col("name").alias("parent_name"))
    refs = refs.join(known, ["rel_fname", "parent_name"], "left_semi").where("name is not null")
    return Factors.of(refs.select(symbol_id("rel_fname", "parent_name").alias("src"), "name", "r"), defs.where("name is not null").select(symbol_id("rel_fname", "name").alias("dst"), "name", "d"))


def degrees(nodes: DataFrame, factors: Factors) -> DataFrame:
    """``id, in_degree, out_degree`` with the weights of all edges, loops left out."""
    zero = F.lit(0).cast("bigint")
    by_ref = factors.refs.groupBy("name").agg(F.sum("r").alias("rs"))
    by_def = factors.defs.groupBy("name").agg(F.sum("d").alias("ds"))
    out = factors.refs.join(by_def, "name").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("r") * F.col("ds")).alias("o"))
    into = factors.defs.join(by_ref, "name").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("d") * F.col("rs")).alias("i"))
    loops = factors.loops.groupBy("id").agg(F.sum("w").alias("w"))
    ends = out.select("id", "o", zero.alias("i"), zero.alias("w")).unionByName(into.select("id", zero.alias("o"), "i", zero.alias("w"))).unionByName(loops.select("id", zero.alias("o"), zero.alias("i"), "w"))
    summed = ends.groupBy("id").agg((F.sum("i") - F.sum("w")).alias("in_degree"), (F.sum("o") - F.sum("w")).alias("out_degree"))
    return nodes.select("id").join(summed, "id", "left").na.fill(0)


def vertices(factors: Factors) -> DataFrame:
    """Ids that an edge leaves or reaches."""
    ids = factors.refs.select(F.col("src").alias("id")).unionByName(factors.defs.select(F.col("dst").alias("id"))).distinct()
    return degrees(ids, factors).where("in_degree > 0 or out_degree > 0").select("id")


def pagerank(weights: DataFrame, factors: Factors, *, iterations: int | None = None, config: Config = DEFAULT, cut: int = 2) -> DataFrame:
    """The ranks of ``graph.pagerank`` over the edges that the factors stand for.

    A round goes from the sources to the names that they refer to, and from the
    names to what defines them; what a vertex would send itself is taken off.
    """
    nodes = weights.select("id")
    loops = factors.loops.groupBy("id").agg(F.sum("w").alias("w"))
    senders = degrees(nodes, factors).where("out_degree > 0").join(loops, "id", "left").select("id", "out_degree", F.coalesce("w", F.lit(0)).alias("w"))
    refs, defs = factors.refs, factors.defs

    def flow(ranks: DataFrame) -> DataFrame:
        sent = ranks.where("out_degree > 0").select("id", "w", (F.col("rank") / F.col("out_degree")).alias("x"))
        names = refs.join(sent.select(F.col("id").alias("src"), "x"), "src").groupBy("name").agg(F.sum(F.col("r") * F.col("x")).alias("s"))
        reached = defs.join(names, "name").select(F.col("dst").alias("id"), (F.col("d") * F.col("s")).alias("v"))
        own = sent.where("w > 0").select("id", (-F.col("w") * F.col("x")).alias("v"))
        return reached.unionByName(own).groupBy("id").agg(F.sum("v").alias("flow"))

    return graph.iterated(weights, senders, flow, iterations=iterations, config=config, cut=cut)


def symbol_pagerank(factors: Factors, *, iterations: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """``file, symbol, rank``."""
    nodes = vertices(factors)
    ranks = pagerank(graph.personalization(nodes, F.get_json_object("id", "$.f"), config=config), factors, iterations=iterations, config=config)
    return ranks.select(F.get_json_object("id", "$.f").alias("file"), F.get_json_object("id", "$.s").alias("symbol"), "rank")


def _kinds(rows: DataFrame, id_col: str, hot: DataFrame) -> DataFrame:
    """``id, mask``: which of the hot names (as bits) each id has."""
    return rows.join(F.broadcast(hot), "name").groupBy(F.col(id_col).alias("id")).agg(F.bit_or("bit").alias("mask"))  # HOT rows


def edge_count(factors: Factors, hot: int = HOT) -> DataFrame:
    """``edges``: how many different pairs of ids the edges join.

    The ``hot`` names with the most pairs are counted by sets: ids are of one
    kind if they refer to (define) the same of these names; two kinds with a
    name in common are joined throughout, which sums over subsets count for all
    kinds at once.  The pairs of the other names are listed, less those that the
    hot names have already.
    """
    refs, defs = factors.refs.select("src", "name").distinct(), factors.defs.select("dst", "name").distinct()
    spark = refs.sparkSession
    sizes = refs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(defs.groupBy("name").agg(F.count(F.lit(1)).alias("m")), "name")
    top = sizes.orderBy(F.desc(F.col("n") * F.col("m")), "name").limit(hot).select("name").collect()
    table = spark.createDataFrame([(r["name"], 1 << i) for i, r in enumerate(top)], "name string, bit int")
    sources, targets = durable(_kinds(refs, "src", table)), durable(_kinds(defs, "dst", table))
    # 2 ** hot rows at most
    counts = [np.zeros(1 << hot, "O"), np.zeros(1 << hot, "O")]
    for count, kinds in zip(counts, (sources, targets)):
        for r in kinds.groupBy("mask").count().collect():
            count[r["mask"]] = r["count"]
    inside = counts[1].copy()  # targets all of whose names are within a set
    for bit in range(hot):
        sets = np.arange(1 << hot)
        inside[sets >> bit & 1 == 1] += inside[sets[sets >> bit & 1 == 1] ^ 1 << bit]
    everything = (1 << hot) - 1
    met = sum(int(c) * (int(counts[1].sum()) - int(inside[everything ^ m])) for m, c in enumerate(counts[0]) if c)
    own = sources.join(targets.withColumnRenamed("mask", "other"), "id").where("mask & other <> 0").count()
    rest = refs.join(F.broadcast(table), "name", "left_anti").join(defs, "name").where("src <> dst").select("src", "dst").distinct()
    rest = rest.join(sources.select(F.col("id").alias("src"), F.col("mask").alias("a")), "src", "left").join(targets.select(F.col("id").alias("dst"), F.col("mask").alias("b")), "dst", "left")
    rest = rest.where("coalesce(a, 0) & coalesce(b, 0) = 0")
    return rest.agg((F.count(F.lit(1)) + F.lit(met - own)).cast("bigint").alias("edges"))


def density(factors: Factors) -> DataFrame:
    """One row ``nodes, edges, density``."""
    counted = edge_count(factors).crossJoin(vertices(factors).agg(F.count(F.lit(1)).alias("nodes")))  # one row each
    return counted.select("nodes", "edges", graph.density(F.col("nodes"), F.col("edges")).alias("density"))

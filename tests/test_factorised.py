"""Factorised graphs against the edge tables that they stand for, and on names that every file has."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import factorised, graph

SCHEMA = "rel_fname string, name string, kind string, parent_name string"


def random_tags(spark, seed, files=12, names=8, rows=160):
    rnd = random.Random(seed)
    name = lambda: rnd.choice([None, *(f"n{i}" for i in range(names))])
    found = [(f"f{rnd.randrange(files)}", name(), rnd.choice(["def", "ref", "ref"]), rnd.choice([None, "n0", "n1", "gone"])) for _ in range(rows)]
    return spark.createDataFrame(found + found[:20], SCHEMA)


def rounded(df):
    return {r[0]: tuple(round(x, 9) if isinstance(x, float) else x for x in r[1:]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_files(spark, seed):
    tags = random_tags(spark, seed)
    nodes = tags.select(F.col("rel_fname").alias("id")).distinct().unionByName(spark.createDataFrame([("lonely",)], "id string"))
    edges, factors = graph.file_edges(tags), factorised.file_factors(tags)
    assert rounded(factorised.degrees(nodes, factors)) == rounded(graph.degrees(nodes, edges))
    assert {r.id for r in factorised.vertices(factors).collect()} == {r.id for r in graph.vertices(edges).collect()}
    assert [factorised.edge_count(factors, hot).first().edges for hot in (0, 1, 3, 12)] == [edges.count()] * 4
    weights = graph.personalization(nodes, F.col("id"), ["f3"])
    assert rounded(factorised.pagerank(weights, factors, iterations=4)) == rounded(graph.pagerank(weights, edges, iterations=4))


def test_symbols(spark):
    tags = random_tags(spark, 3, files=4, names=4)
    edges = graph.symbol_edges(tags)
    got = {(r.file, r.symbol): round(r.rank, 9) for r in factorised.symbol_pagerank(factorised.symbol_factors(tags), iterations=3).collect()}
    assert got == {(r.file, r.symbol): round(r.rank, 9) for r in graph.symbol_pagerank(edges, iterations=3).collect()} and len(got) > 3


def test_no_tags(spark):
    factors = factorised.file_factors(spark.createDataFrame([], SCHEMA))
    assert factorised.edge_count(factors).first().edges == 0 and factorised.vertices(factors).count() == 0
    assert factorised.density(factors).first().density == 1.0


def test_a_name_in_every_file(spark):
    """40,000 files that all refer to a name and define it: 1.6 billion edges, none of which is made."""
    n = 40_000
    ids = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("rel_fname"))
    row = lambda kind, name: ids.select("rel_fname", name.alias("name"), F.lit(kind).alias("kind"))
    tags = row("ref", F.lit("init")).unionByName(row("def", F.lit("init"))).unionByName(row("def", F.col("rel_fname"))).unionByName(row("ref", F.lit("f7")))
    factors = factorised.file_factors(tags)
    nodes = ids.select(F.col("rel_fname").alias("id"))
    degree = {r.id: (r.in_degree, r.out_degree) for r in factorised.degrees(nodes, factors).where("id in ('f7', 'f8')").collect()}
    assert degree == {"f7": (2 * (n - 1), n - 1), "f8": (n - 1, n)}
    # the pairs of the second name are among those of the first
    assert factorised.edge_count(factors).first().edges == n * (n - 1)
    ranks = factorised.pagerank(graph.personalization(nodes, F.lit("x")), factors, iterations=2)
    total, top = ranks.agg(F.sum("rank"), F.max_by("id", "rank")).first()
    assert abs(total - 1) < 1e-9 and top == "f7"

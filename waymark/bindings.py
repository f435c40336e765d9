"""The generic relations over star-schema, event, page and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel_fname, name, kind``: suppliers' nations define parts, customers' nations refer to them."""
    t = lambda n, *c: table(spark, sf_dir, n, *c)
    nation = t("nation", "n_nationkey", "n_name")
    items = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    suppliers = t("supplier", "s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customers = t("customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    defs = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    refs = items.join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    shape = lambda df, kind: df.select(F.col("n_name").alias("rel_fname"), F.col("l_partkey").cast("string").alias("name"), F.lit(kind).alias("kind"))
    return shape(defs, "def").unionByName(shape(refs, "ref"))


TAGS = """tags AS (
  SELECT n_name AS rel_fname, CAST(l_partkey AS VARCHAR) AS name, 'def' AS kind FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT n_name, CAST(l_partkey AS VARCHAR), 'ref' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

EDGES = (
    TAGS
    + """, edges AS (
  SELECT r.rel_fname AS src, d.rel_fname AS dst, count(*) AS weight
  FROM (SELECT DISTINCT rel_fname, name FROM tags WHERE kind = 'ref') r JOIN (SELECT DISTINCT rel_fname, name FROM tags WHERE kind = 'def') d ON r.name = d.name
  WHERE r.rel_fname <> d.rel_fname GROUP BY 1, 2)"""
)


def symbol_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel_fname, name, kind, parent_name``: a symbol is a nation's brand; a reference's scope is the brand of its order's first line."""
    t = lambda n, *c: table(spark, sf_dir, n, *c)
    nation, part = t("nation", "n_nationkey", "n_name"), t("part", "p_partkey", "p_brand")
    items = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    suppliers = t("supplier", "s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    defs = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("n_name").alias("rel_fname"), F.col("p_brand").alias("name")).distinct()
    scope = items.groupBy(F.col("l_orderkey").alias("so")).agg(F.min(F.struct("l_linenumber", "l_partkey", "p_brand"))["p_brand"].alias("parent_name"))
    customers = t("customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    refs = items.join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(scope, F.col("l_orderkey") == F.col("so"))
    return defs.select("rel_fname", "name", F.lit("def").alias("kind"), F.lit(None).cast("string").alias("parent_name")).unionByName(refs.select(F.col("n_name").alias("rel_fname"), F.col("p_brand").alias("name"), F.lit("ref").alias("kind"), "parent_name"))


SYMBOL_EDGES = """items AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
 defs AS (SELECT DISTINCT n_name AS f, p_brand AS s FROM items JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
 scope AS (SELECT l_orderkey AS so, arg_min(p_brand, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS parent FROM items GROUP BY 1),
 refs AS (SELECT n_name AS f, parent AS p, p_brand AS s, count(*) AS n FROM items JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN scope ON so = l_orderkey GROUP BY 1, 2, 3),
 sedges AS (SELECT r.f AS src_file, r.p AS src_sym, d.f AS dst_file, d.s AS dst_sym, sum(r.n) AS n FROM refs r JOIN defs k ON k.f = r.f AND k.s = r.p JOIN defs d ON d.s = r.s WHERE r.f <> d.f OR r.p <> d.s GROUP BY 1, 2, 3, 4)"""


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits to customers by priorities."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("commit_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("author"), F.col("o_custkey").cast("string").alias("file"))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits to users by types."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("commit_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("author"), F.col("user_id").cast("string").alias("file"))


ORDER_HISTORY = "h AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit_id, o_orderdate AS ts, o_orderpriority AS author, CAST(o_custkey AS VARCHAR) AS file FROM orders)"
EVENT_HISTORY = "h AS (SELECT CAST(event_id AS VARCHAR) AS commit_id, ts, event_type AS author, CAST(user_id AS VARCHAR) AS file FROM events)"


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commit_id, file``: customers touch the brands that they order."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.join(table(spark, sf_dir, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").cast("string").alias("commit_id"), F.col("p_brand").alias("file")).distinct()


TOUCHES = "t AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS commit_id, p_brand AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, brand, rank``: parts ranked by quantity sold (whole numbers, so sums are exact)."""
    sold = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("rank"))
    return sold.join(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


PART_RANKS = "pr AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, sum(l_quantity) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"

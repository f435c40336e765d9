"""Graph export and diagnostics lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Config
from waymark.functions import paths, text
from waymark.operators import graph, statistics


def nodes(ranks: DataFrame, edges: DataFrame, *, bridges: DataFrame | None = None, api: DataFrame | None = None) -> DataFrame:
    """Nodes ``id, file, symbol, rank, in_degree, out_degree, cluster, is_bridge, is_api, is_orphan``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_file").alias("file"), F.col("src_sym").alias("symbol"), F.lit(0).cast("bigint").alias("i"), F.col("n").alias("o")), F.struct(F.col("dst_file").alias("file"), F.col("dst_sym").alias("symbol"), F.col("n").alias("i"), F.lit(0).cast("bigint").alias("o")))).alias("e")).select("e.*")
    degree = ends.groupBy("file", "symbol").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = ranks.join(degree, ["file", "symbol"], "left").na.fill(0, ["in_degree", "out_degree"])
    if bridges is not None:
        out = out.join(bridges.select(F.col("id").alias("file"), F.lit(True).alias("is_bridge")).distinct(), "file", "left")
    if api is not None:
        out = out.join(api.where("label = 'api'").select("file", "symbol", F.lit(True).alias("is_api")).distinct(), ["file", "symbol"], "left")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)).alias(n) if n in out.columns else F.lit(False).alias(n)
    return out.select(text.node_id(F.col("file"), F.col("symbol")).alias("id"), "file", "symbol", text.ellipsis(F.col("symbol")).alias("label"), "rank", "in_degree", "out_degree", paths.parent_dir(F.col("file")).alias("cluster"), flag("is_bridge"), flag("is_api"), (F.col("in_degree") == 0).alias("is_orphan"))


def links(edges: DataFrame) -> DataFrame:
    """``source, target, weight``."""
    return edges.groupBy(text.node_id(F.col("src_file"), F.col("src_sym")).alias("source"), text.node_id(F.col("dst_file"), F.col("dst_sym")).alias("target")).agg(F.sum("n").alias("weight"))


def as_json(rows: DataFrame) -> DataFrame:
    """A JSON document per row, for ``write.text``."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_graph(node_rows: DataFrame, link_rows: DataFrame, path: str) -> None:
    """JSON lines of nodes and links."""
    node_rows.write.mode("overwrite").json(f"{path}/nodes")
    link_rows.write.mode("overwrite").json(f"{path}/links")


def report(tags: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """One row ``definition_matches, reference_matches, total_files_considered, excluded``."""
    got = tags.agg(F.count_if(F.col("kind") == "def").alias("definition_matches"), F.count_if(F.col("kind") == "ref").alias("reference_matches"), F.countDistinct("rel_fname").alias("total_files_considered"))
    if excluded is None:
        return got.withColumn("excluded", F.create_map().cast("map<string,string>"))
    return got.crossJoin(excluded.agg(F.map_from_entries(F.collect_list(F.struct("path", "reason"))).alias("excluded")))  # one row each


def diagnostics(node_ids: DataFrame, edges: DataFrame, ranks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row ``line``: graph and rank parts of the diagnostics."""
    degree = graph.degrees(node_ids, edges)
    size = degree.agg(F.count(F.lit(1)).alias("n"), F.sum("in_degree").alias("e"), F.count_if(F.col("in_degree") == 0).alias("orphans"))
    top = graph.hubs(degree, 5).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("in_degree")).alias("k"), "id", "in_degree"))), lambda x: F.concat_ws(":", x["id"].cast("string"), x["in_degree"].cast("string"))), ",").alias("hubs"))
    parts = size.crossJoin(top).crossJoin(statistics.summary(ranks)).crossJoin(statistics.gini(ranks).select("gini")).crossJoin(statistics.cliff(ranks))  # one row each
    dense = F.when(F.col("n") > 1, 100.0 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    line = F.concat(
        F.format_string("G:%dn/%de/%.1f%%d hub:%s orph:%d | R:%.4f/%.4f/%.4f/%.4f gini:%.2f", "n", "e", dense, "hubs", "orphans", "lowest", "p50", "p90", "highest", "gini"),
        F.when(F.coalesce("cliff", F.lit(0)) > 0, F.concat(F.lit(" cliff@p"), F.col("cliff").cast("string"))).otherwise(""),
        F.lit(f" | HP:α{config.alpha}/dec{config.recency_days:.0f}/chat{config.boost_focus:.0f}/vend{config.weight_vendor}/churn{config.churn_threshold}/rec{config.recency_max}"),
    )
    return parts.select(line.alias("line"))


def git_part(weights: DataFrame, n: int = 5) -> DataFrame:
    """``GIT:name:weight,...`` of the files that history lifts most; empty without any."""
    top = weights.where("weight > 1").orderBy(F.desc("weight"), "file").limit(n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("k"), "file", "weight"))), lambda x: F.concat(text.basename(x["file"]), F.lit(":"), F.format_string("%.2f", x["weight"])))
    return top.agg(F.array_join(listed, ",").alias("l")).select(F.when(F.col("l") == "", "").otherwise(F.concat(F.lit("GIT:"), F.col("l"))).alias("line"))


def top_part(ranked: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """``TOP:name:rank:references↓,...``: the best rows of ``rel_fname, name, rank``, a name once, with what refers to its symbol."""
    best = ranked.groupBy("name").agg(F.max(F.struct("rank", "rel_fname")).alias("b")).select("name", "b.rank", "b.rel_fname").orderBy(F.desc("rank"), "name").limit(n)
    referred = edges.groupBy(F.col("dst_file").alias("rel_fname"), F.col("dst_sym").alias("name")).agg(F.sum("n").alias("refs"))
    rows = best.join(referred, ["rel_fname", "name"], "left").select("name", "rank", F.coalesce("refs", F.lit(0)).alias("refs"))
    shown = lambda x: F.concat(F.substring(x["name"], 1, 12), F.lit(":"), F.format_string("%.3f", x["rank"]), F.lit(":"), x["refs"].cast("string"), F.lit("↓"))
    return rows.agg(F.concat(F.lit("TOP:"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("k"), "name", "rank", "refs"))), shown), ",")).alias("line"))


def token_part(budget: int, used: int, detail: str, shown: int, total: int) -> str:
    """``TOK:``, how far the budget is used."""
    return f"TOK:{budget}/{used}/{100 * used / budget if budget > 0 else 0:.0f}% {detail} tags:{shown}/{total}"


def boost_part(symbols: float, weights: float, config: Config = DEFAULT) -> str:
    """``B:``, the largest factors of a rank."""
    return f"B:pr→sym*{symbols:.1f}→git*{weights:.1f}→foc*{config.boost_focus:.0f} chain:{symbols * weights * config.boost_focus:.0f}x"

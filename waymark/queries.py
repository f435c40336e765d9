"""Queries that apply each operator to the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import bindings as B
from waymark.bindings import table
from waymark.config import HIGH, LOW, MEDIUM
from waymark.functions import paths, scoring, text
from waymark.operators import context, export, extract, graph, history, ordering, packing, statistics, views
from waymark.session import durable, workers_find_package
from waymark.sources import cache, files
from waymark.sources import history as logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# --- graph ---------------------------------------------------------------------------------------------------------


@query(f"WITH {B.TAGS} SELECT kind, count(*) AS n, count(DISTINCT name) AS names, count(DISTINCT rel_fname) AS files FROM tags GROUP BY kind")
def a01_kind_totals(spark, d):
    return B.tags(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("rel_fname").alias("files"))


@query(f"WITH {B.EDGES} SELECT src, dst, weight FROM edges")
def j01_file_edges(spark, d):
    return graph.file_edges(B.tags(spark, d))


@query(f"WITH {B.EDGES} SELECT n_name AS id, CAST(coalesce((SELECT sum(weight) FROM edges WHERE dst = n_name), 0) AS BIGINT) AS in_degree, CAST(coalesce((SELECT sum(weight) FROM edges WHERE src = n_name), 0) AS BIGINT) AS out_degree FROM nation")
def a03_degrees(spark, d):
    return graph.degrees(table(spark, d, "nation").select(F.col("n_name").alias("id")), graph.file_edges(B.tags(spark, d)))


@query(f"WITH {B.EDGES} SELECT dst AS id, CAST(sum(weight) AS BIGINT) AS in_degree FROM edges GROUP BY dst ORDER BY in_degree DESC, id LIMIT 10")
def a04_hubs(spark, d):
    edges = graph.file_edges(B.tags(spark, d))
    return graph.hubs(graph.degrees(graph.vertices(edges), edges)).select("id", "in_degree")


@query(f"WITH {B.EDGES}, sparse AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM edges) SELECT n_name AS id FROM nation WHERE n_name NOT IN (SELECT dst FROM sparse WHERE k <= 3)")
def a05_orphans(spark, d):
    sparse = ordering.top_per_group(graph.file_edges(B.tags(spark, d)), ["src"], 3, F.desc("weight"), F.col("dst"))
    return graph.orphans(table(spark, d, "nation").select(F.col("n_name").alias("id")), sparse)


@query(f"WITH {B.EDGES}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1.0)), 6) AS density FROM edges")
def a07_density(spark, d):
    edges = graph.file_edges(B.tags(spark, d))
    counted = edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(graph.vertices(edges).agg(F.count(F.lit(1)).alias("nodes")))
    return counted.select("nodes", "edges", F.round(graph.density(F.col("nodes"), F.col("edges")), 6).alias("density"))


_RANK_STEPS = 20
_PAGERANK = f"""WITH RECURSIVE {B.EDGES},
 w AS (SELECT n_name AS id, CASE WHEN n_name = 'NATION_7' THEN 100.0 ELSE 1.0 END AS weight FROM nation),
 q AS (SELECT id, weight / (SELECT sum(weight) FROM w) AS q FROM w),
 p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges),
 stuck AS (SELECT id FROM q WHERE id NOT IN (SELECT src FROM edges)),
 it(k, id, rank) AS (
  SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM q) FROM q
  UNION ALL
  SELECT n.k + 1, n.id, 0.85 * n.flow + 0.15 * n.q + 0.85 * n.lost * n.q FROM (
   SELECT b.k, q.id, any_value(q.q) AS q, sum(CASE WHEN p.dst = q.id THEN b.rank * p.p ELSE 0 END) AS flow, any_value(b.lost) AS lost
   FROM (SELECT it.k, it.id, it.rank, sum(CASE WHEN it.id IN (SELECT id FROM stuck) THEN it.rank ELSE 0 END) OVER () AS lost FROM it WHERE it.k < {_RANK_STEPS}) b
   LEFT JOIN p ON p.src = b.id, q GROUP BY b.k, q.id) n)
"""


def _file_ranks(spark, d):
    edges = graph.file_edges(B.tags(spark, d))
    nodes = table(spark, d, "nation").select(F.col("n_name").alias("id"))
    return graph.pagerank(graph.personalization(nodes, F.col("id"), ["NATION_7"]), edges, iterations=_RANK_STEPS)


@query(_PAGERANK + f"SELECT id, round(rank, 6) AS rank FROM it WHERE k = {_RANK_STEPS}")
def g01_file_pagerank(spark, d):
    return rounded(_file_ranks(spark, d), "rank")


@query(_PAGERANK + f"SELECT id, round(rank, 6) AS rank FROM it WHERE k = {_RANK_STEPS} ORDER BY round(rank, 6) DESC, id LIMIT 10")
def o01_top_ranked(spark, d):
    return rounded(_file_ranks(spark, d), "rank").orderBy(F.desc("rank"), "id").limit(10)


@query(f"WITH {B.SYMBOL_EDGES} SELECT src_file, src_sym, dst_file, dst_sym, CAST(n AS BIGINT) AS n FROM sedges")
def j02_symbol_edges(spark, d):
    return graph.symbol_edges(B.symbol_tags(spark, d))


@query(f"WITH {B.SYMBOL_EDGES} SELECT src_file AS src, dst_file AS dst, CAST(sum(n) AS BIGINT) AS weight FROM sedges WHERE src_file <> dst_file GROUP BY 1, 2")
def g04_collapse(spark, d):
    return graph.collapse(graph.symbol_edges(B.symbol_tags(spark, d)))


_SYMBOL_STEPS = 5
_SYMBOL_RANK = (
    f"WITH RECURSIVE {B.SYMBOL_EDGES}, e AS (SELECT src_file || ':' || src_sym AS src, dst_file || ':' || dst_sym AS dst, n AS weight FROM sedges), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), "
    "p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), nv AS (SELECT count(*) AS n FROM v), stuck AS (SELECT id FROM v WHERE id NOT IN (SELECT src FROM e)), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, nv)"
    + "".join(
        f", l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id IN (SELECT id FROM stuck)), f{k} AS (SELECT p.dst AS id, sum(r.rank * p.p) AS flow FROM p JOIN r{k} r ON r.id = p.src GROUP BY 1), r{k + 1} AS (SELECT v.id, 0.85 * coalesce(f.flow, 0) + (0.15 + 0.85 * l.lost) / nv.n AS rank FROM v LEFT JOIN f{k} f ON f.id = v.id, l{k} l, nv)"
        for k in range(_SYMBOL_STEPS)
    )
)


@query(_SYMBOL_RANK + f" SELECT split_part(id, ':', 1) AS file, split_part(id, ':', 2) AS symbol, round(rank, 7) AS rank FROM r{_SYMBOL_STEPS}")
def g02_symbol_pagerank(spark, d):
    return rounded(graph.symbol_pagerank(durable(graph.symbol_edges(B.symbol_tags(spark, d))), iterations=_SYMBOL_STEPS), "rank", digits=7)


@query(_SYMBOL_RANK + f" SELECT split_part(id, ':', 1) AS file, round(max(rank), 7) AS file_rank FROM r{_SYMBOL_STEPS} GROUP BY 1")
def a02_file_rank_of_symbols(spark, d):
    return rounded(graph.file_ranks(graph.symbol_pagerank(durable(graph.symbol_edges(B.symbol_tags(spark, d))), iterations=_SYMBOL_STEPS)), "file_rank", digits=7)


def _sparse(spark, d):
    return ordering.top_per_group(graph.file_edges(B.tags(spark, d)), ["src"], 3, F.desc("weight"), F.col("dst")).select("src", "dst", "weight")


@query()
def g05_betweenness(spark, d):
    return rounded(graph.betweenness(_sparse(spark, d)), "betweenness")


@query()
def g06_bridges(spark, d):
    found = graph.bridges(_sparse(spark, d))
    return rounded(found, "betweenness").select("id", "betweenness", F.array_join("connects", ",").alias("connects"))


@query(f"WITH {B.EDGES}, s AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM edges) WHERE k <= 3), dg AS (SELECT id, sum(w) AS degree FROM (SELECT src AS id, weight AS w FROM s UNION ALL SELECT dst, weight FROM s) GROUP BY 1), nb AS (SELECT src AS id, dst AS other FROM s UNION SELECT dst, src FROM s), r AS (SELECT nb.id, other, row_number() OVER (PARTITION BY nb.id ORDER BY degree DESC, other) AS k FROM nb JOIN dg ON dg.id = other) SELECT id, string_agg(other, ',' ORDER BY k) AS connects FROM r WHERE k <= 2 GROUP BY id")
def o06_neighbours(spark, d):
    return graph.neighbours(_sparse(spark, d)).select("id", F.array_join("connects", ",").alias("connects"))


_SURFACE = f"WITH {B.SYMBOL_EDGES}, c AS (SELECT DISTINCT dst_file, dst_sym, src_file, src_sym FROM sedges), s AS (SELECT dst_file AS file, dst_sym AS symbol, count(*) FILTER (src_file <> dst_file) AS external, count(*) FILTER (src_file = dst_file) AS internal FROM c GROUP BY 1, 2), l AS (SELECT *, CASE WHEN external + internal = 0 THEN 'unknown' WHEN external / (external + internal) > 0.5 THEN 'api' WHEN internal / (external + internal) > 0.8 THEN 'internal' ELSE 'unknown' END AS label FROM s)"


@query(_SURFACE + " SELECT file, symbol, external, internal, label FROM l")
def g08_surface(spark, d):
    return graph.surface(graph.symbol_edges(B.symbol_tags(spark, d)))


@query(_SURFACE + " SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM l GROUP BY label")
def a27_surface_totals(spark, d):
    return rounded(graph.surface_totals(graph.surface(graph.symbol_edges(B.symbol_tags(spark, d)))), "percent")


@query(f"WITH {B.SYMBOL_EDGES} SELECT DISTINCT src_file AS file FROM sedges WHERE dst_file = 'NATION_3' AND dst_sym = 'Brand#5'")
def g07_callers(spark, d):
    focus = spark.createDataFrame([("NATION_3", "Brand#5")], "file string, symbol string")
    return graph.callers(graph.symbol_edges(B.symbol_tags(spark, d)), focus)


# --- history -------------------------------------------------------------------------------------------------------

_STATS = f"WITH {B.ORDER_HISTORY}, s AS (SELECT file, count(*) AS commits, min(ts) AS first_seen, max(ts) AS last_modified, string_agg(DISTINCT author, '|' ORDER BY author) AS authors FROM h GROUP BY file), nw AS (SELECT max(ts) AS now FROM h), a AS (SELECT s.*, CAST(floor((epoch_us(now) - epoch_us(last_modified)) / 86400000000) AS BIGINT) AS quiet, CAST(floor((epoch_us(now) - epoch_us(first_seen)) / 86400000000) AS BIGINT) AS age FROM s, nw)"


def _order_stats(spark, d):
    rows = B.order_history(spark, d)
    return history.file_stats(rows), F.lit(rows.agg(F.max("ts")).first()[0])


@query(_STATS + " SELECT file, commits, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_modified, '%Y-%m-%d') AS last_modified, authors FROM s")
def a08_file_stats(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _order_stats(spark, d)[0].select("file", "commits", day("first_seen"), day("last_modified"), F.array_join("authors", "|").alias("authors"))


@query(_STATS + " SELECT file, quiet AS age, commits, round((1 + (CASE WHEN quiet <= 0 THEN 2.0 ELSE 1 + exp(-quiet / 30.0) END - 1) * 1.5) * (1 + (CASE WHEN commits <= 5 THEN 1.0 ELSE least(1 + ln(1 + commits - 5) * 0.1, 1.5) END - 1) * 0.8), 6) AS weight FROM a")
def g10_git_weights(spark, d):
    stats, now = _order_stats(spark, d)
    return rounded(history.file_weights(stats, now, recency=1.5, churn=0.8), "weight")


@query(_STATS + " , w AS (SELECT file, CASE WHEN quiet <= 0 THEN 2.0 ELSE 1 + exp(-quiet / 30.0) END * CASE WHEN commits <= 5 THEN 1.0 ELSE least(1 + ln(1 + commits - 5) * 0.1, 1.5) END AS weight FROM a) SELECT count(*) FILTER (weight > 1.0000001) AS boosted, round(max(weight), 6) AS highest FROM w")
def a26_boosted_files(spark, d):
    stats, now = _order_stats(spark, d)
    return history.file_weights(stats, now).agg(F.count_if(F.col("weight") > 1.0000001).alias("boosted"), F.round(F.max("weight"), 6).alias("highest"))


@query(_STATS + ", m AS (SELECT list_sort(list(commits))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM s WHERE commits > 0) SELECT file, age, quiet, commits, CASE WHEN age >= 180 AND quiet >= 30 THEN 'crystal' WHEN age >= 90 AND quiet <= 14 AND commits > 1.5 * median THEN 'rotting' WHEN age <= 30 THEN 'emergent' ELSE 'evolving' END AS phase FROM a, m")
def x14_phases(spark, d):
    return history.file_phases(*_order_stats(spark, d))


@query(_STATS + " SELECT file, concat_ws(',', CASE WHEN quiet <= 7 THEN 'recent' END, CASE WHEN commits >= 10 THEN 'high-churn' END) AS badges FROM a")
def x15_badges(spark, d):
    return history.file_badges(*_order_stats(spark, d)).select("file", F.array_join("badges", ",").alias("badges"))


@query(_STATS + " SELECT CAST(list_sort(list(commits))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS DOUBLE) AS median FROM s WHERE commits > 0")
def a14_upper_median(spark, d):
    return statistics.upper_median(_order_stats(spark, d)[0], "commits")


_COUPLING = f"WITH {B.TOUCHES}, z AS (SELECT file, count(*) AS n FROM t GROUP BY file), p AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM t x JOIN t y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2), c AS (SELECT a, b, together, together / (za.n + zb.n - together) AS score FROM p JOIN z za ON za.file = a JOIN z zb ON zb.file = b)"


@query(_COUPLING + " SELECT a, b, together, round(score, 6) AS score FROM c WHERE score >= 0.3")
def g09_coupling(spark, d):
    return rounded(history.coupling(B.touches(spark, d)), "score")


@query(_COUPLING + " SELECT a, b, together, round(score, 6) AS score FROM c WHERE score >= 0.65")
def g09_coupling_selective(spark, d):
    return rounded(history.coupling(B.touches(spark, d), threshold=0.65), "score")


@query(_COUPLING + ", k AS (SELECT a AS file, b AS mate, score FROM c WHERE score >= 0.65 UNION ALL SELECT b, a, score FROM c WHERE score >= 0.65) SELECT p.file, coalesce(string_agg(mate, ',' ORDER BY score DESC, mate), '') AS mates FROM (SELECT DISTINCT file FROM t) p LEFT JOIN k ON k.file = p.file GROUP BY p.file")
def o07_coupling_lists(spark, d):
    t = B.touches(spark, d)
    lists = history.coupling_lists(t.select("file").distinct(), history.coupling(t, threshold=0.65))
    return lists.select("file", F.array_join(F.transform("mates", lambda m: m["mate"]), ",").alias("mates"))


@query(_COUPLING + " SELECT DISTINCT CASE WHEN a = 'Brand#1' THEN b ELSE a END AS file FROM c WHERE score >= 0.65 AND 'Brand#1' IN (a, b)")
def j07_change_mates(spark, d):
    return history.mates(spark.createDataFrame([("Brand#1",)], "file string"), history.coupling(B.touches(spark, d), threshold=0.65))


@query(_COUPLING + " SELECT (SELECT count(DISTINCT f) FROM (SELECT a AS f FROM c WHERE score >= 0.65 UNION ALL SELECT b FROM c WHERE score >= 0.65)) AS files, count(*) AS pairs FROM c WHERE score >= 0.65")
def a29_coupling_summary(spark, d):
    return history.coupling_summary(history.coupling(B.touches(spark, d), threshold=0.65))


@query(f"WITH {B.TOUCHES}, s AS (SELECT commit_id, count(DISTINCT file) AS size FROM t GROUP BY 1) SELECT count(*) AS commits, round(avg(size), 6) AS mean, max(size) AS largest FROM s")
def a09_commit_sizes(spark, d):
    return history.commit_sizes(B.touches(spark, d)).agg(F.count(F.lit(1)).alias("commits"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("largest"))


_STORY = f"WITH {B.EVENT_HISTORY}, c AS (SELECT file, author, count(*) AS n, min(ts) AS since FROM h GROUP BY 1, 2), g AS (SELECT file, count(*) AS commits, strftime(min(ts), '%Y-%m-%d') AS created FROM h GROUP BY 1)"


@query(_STORY + " SELECT g.file, g.commits, g.created, (SELECT author FROM h WHERE h.file = g.file ORDER BY ts, commit_id LIMIT 1) AS created_by, (SELECT author FROM c WHERE c.file = g.file ORDER BY n DESC, since, author LIMIT 1) AS primary_author, (SELECT count(*) FROM c WHERE c.file = g.file) AS n_authors, (SELECT string_agg(commit_id, ',' ORDER BY ts DESC, commit_id DESC) FROM (SELECT * FROM h WHERE h.file = g.file ORDER BY ts DESC, commit_id LIMIT 10)) AS recent FROM g")
def g11_stories(spark, d):
    s = history.stories(B.event_history(spark, d))
    return s.select("file", "commits", F.date_format("first", "yyyy-MM-dd").alias("created"), "created_by", "primary_author", F.size("authors").cast("bigint").alias("n_authors"), F.array_join(F.transform("recent", lambda r: r["commit_id"]), ",").alias("recent"))


@query(_STORY + " SELECT g.file || ': created ' || created || ' by ' || (SELECT author FROM h WHERE h.file = g.file ORDER BY ts, commit_id LIMIT 1) || ' ' || commits || ' commits ' || (SELECT count(*) FROM c WHERE c.file = g.file) || ' authors' AS card FROM g")
def x39_story_cards(spark, d):
    s = history.stories(B.event_history(spark, d))
    return s.select(text.story_card(F.col("file"), F.col("first"), F.col("created_by"), F.col("commits"), F.size("authors")).alias("card"))


@query(f"WITH {B.EVENT_HISTORY}, k AS (SELECT commit_id FROM h GROUP BY 1 ORDER BY max(ts) DESC, commit_id LIMIT 500) SELECT file, count(*) AS commits FROM h WHERE commit_id IN (SELECT commit_id FROM k) GROUP BY file")
def s10_history_horizon(spark, d):
    return history.horizon(B.event_history(spark, d), 500).groupBy("file").agg(F.count(F.lit(1)).alias("commits"))


# --- statistics ----------------------------------------------------------------------------------------------------

_SORTED = f"WITH {B.PART_RANKS}, o AS (SELECT rank AS x, row_number() OVER (ORDER BY rank) AS i, count(*) OVER () AS n FROM pr)"


@query(_SORTED + " SELECT count(*) AS n, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM o")
def a15_gini(spark, d):
    return rounded(statistics.gini(B.part_ranks(spark, d)), "gini")


@query(f"WITH {B.PART_RANKS}, t AS (SELECT sum(rank) AS s FROM pr) SELECT round(-sum(rank / s * log2(rank / s)), 6) AS entropy FROM pr, t WHERE rank > 0")
def a16_entropy(spark, d):
    return rounded(statistics.entropy(B.part_ranks(spark, d)), "entropy")


@query(_SORTED + " SELECT " + ", ".join(f"max(x) FILTER (i - 1 = least(n * {p} // 100, n - 1)) AS p{p}" for p in (10, 50, 90)) + " FROM o")
def a17_percentiles(spark, d):
    return statistics.percentiles(B.part_ranks(spark, d), (10, 50, 90))


@query(_SORTED + " SELECT min(x) AS lowest, max(x) FILTER (i - 1 = n * 50 // 100) AS p50, max(x) FILTER (i - 1 = n * 90 // 100) AS p90, max(x) AS highest FROM o")
def a18_summary(spark, d):
    return statistics.summary(B.part_ranks(spark, d))


@query("WITH o AS (SELECT p_size * p_size * p_size AS x, row_number() OVER (ORDER BY p_size * p_size * p_size DESC) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part)), l AS (SELECT x, i, n, lag(x) OVER (ORDER BY i) AS b FROM o) SELECT CAST(min(100 * i // n) AS BIGINT) AS cliff FROM l WHERE b > 0 AND x / b < 0.5 AND n >= 10")
def w01_cliff(spark, d):
    sizes = table(spark, d, "part", "p_size").distinct()
    return statistics.cliff(sizes.select(F.pow("p_size", F.lit(3)).alias("rank")))


_SURE = "q AS (SELECT count(*) AS n, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini, max(x) FILTER (i - 1 = n * 10 // 100) AS p10, max(x) FILTER (i - 1 = n * 50 // 100) AS p50, max(x) FILTER (i - 1 = n * 90 // 100) AS p90 FROM o), e AS (SELECT -sum(x / s * log2(x / s)) AS entropy FROM o, (SELECT sum(x) AS s FROM o) WHERE x > 0), f AS (SELECT *, gini < 0.35 AS diffuse, n >= 10 AND p50 <> 0 AND p50 > p10 AND (p90 - p50) / nullif(p50 - p10, 0) > 2.5 AS fragmented FROM q, e)"


@query(_SORTED + f", {_SURE} SELECT n, round(gini, 6) AS gini, round(entropy, 6) AS entropy, round(least(gini / 0.6, 1), 6) AS stability, concat_ws(',', CASE WHEN diffuse THEN 'diffuse' END, CASE WHEN fragmented THEN 'fragmented' END) AS patterns, CASE WHEN n < 3 THEN 'low' WHEN gini >= 0.6 AND entropy < 3.5 AND NOT diffuse THEN 'high' WHEN diffuse OR (diffuse AND fragmented) THEN 'low' ELSE 'medium' END AS level FROM f")
def g12_confidence(spark, d):
    got = statistics.confidence(B.part_ranks(spark, d))
    return rounded(got, "gini", "entropy", "stability").withColumn("patterns", F.array_join("patterns", ","))


# --- windows, top-k, packing ---------------------------------------------------------------------------------------

_BY_BRAND = f"WITH {B.PART_RANKS}, m AS (SELECT p_brand, max(rank) AS max_rank FROM pr GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY max_rank DESC, p_brand) - 1 AS place, count(*) OVER () AS n FROM m)"


def _brand_tags(spark, d):
    return B.part_ranks(spark, d).select(F.col("p_brand").alias("rel_fname"), F.col("p_name").alias("name"), "rank", "p_partkey")


@query(_BY_BRAND + " SELECT p_brand AS rel_fname, max_rank, CASE WHEN p_brand = 'Brand#9' THEN 3 WHEN 1 - place / n >= 0.8 THEN 3 WHEN 1 - place / n >= 0.4 THEN 2 ELSE 1 END AS detail FROM o")
def w02_adaptive_detail(spark, d):
    return views.adaptive_detail(_brand_tags(spark, d), ["Brand#9"])


@query(f"WITH {B.PART_RANKS}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rank DESC, p_partkey) AS k FROM pr) SELECT p_brand, p_partkey, rank FROM r WHERE k <= 5")
def w03_top_per_group(spark, d):
    return ordering.top_per_group(B.part_ranks(spark, d), ["p_brand"], 5, F.desc("rank"), F.col("p_partkey")).select("p_brand", "p_partkey", "rank")


@query("SELECT p_brand AS file, p_type AS pattern, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1 AS first FROM part")
def w04_first_types(spark, d):
    return views.first_types(table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("pattern"), F.col("p_partkey").alias("seq")))


@query(f"WITH {B.PART_RANKS}, b AS (SELECT p_name, max(rank) AS rank FROM pr GROUP BY 1 ORDER BY rank DESC, p_name LIMIT 15) SELECT substr(p_name, 1, 12) AS name, rank FROM b")
def w05_top_names(spark, d):
    return views.top_names(_brand_tags(spark, d))


@query(f"WITH {B.PART_RANKS}, o AS (SELECT p_partkey, length(p_name) AS cost, sum(length(p_name)) OVER (ORDER BY rank DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS running FROM pr) SELECT p_partkey, CAST(running AS DOUBLE) AS running FROM o WHERE running <= 3000")
def w07_budget_prefix(spark, d):
    rows = B.part_ranks(spark, d)
    return packing.prefix(rows, 3000, F.length("p_name").cast("double"), F.desc("rank"), F.col("p_partkey")).select("p_partkey", "running")


@query(f"WITH {B.PART_RANKS}, c AS (SELECT d.detail, pr.p_partkey, pr.rank, length(p_name) * d.detail AS cost FROM pr, (VALUES (1), (2), (3)) d(detail)), o AS (SELECT detail, sum(cost) OVER (PARTITION BY detail ORDER BY rank DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS running FROM c) SELECT detail, count(*) AS tags, CAST(max(running) AS DOUBLE) AS cost, count(*) * 10 + detail AS score FROM o WHERE running <= 2000 GROUP BY detail")
def o12_fit_details(spark, d):
    cost = F.length("p_name").cast("double")
    return packing.fit_details(B.part_ranks(spark, d), 2000, {k: cost * k for k in (LOW, MEDIUM, HIGH)}, F.desc("rank"), F.col("p_partkey"))


_CLUSTER_PATH = "'pkg/src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '/' || p_partkey || '.py'"


def _located(spark, d):
    where = F.concat(F.lit("pkg/src/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return B.part_ranks(spark, d).withColumn("path", where).withColumn("name", F.col("p_name"))


@query(f"WITH {B.PART_RANKS}, c AS (SELECT lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) AS cluster, rank FROM pr) SELECT cluster, count(*) AS symbols, sum(rank) AS rank FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY rank DESC, cluster LIMIT 10")
def a22_clusters(spark, d):
    return views.clusters(_located(spark, d), "path").select("cluster", "symbols", "rank")


@query(f"WITH {B.PART_RANKS}, f AS (SELECT {_CLUSTER_PATH} AS path, p_size, p_type, p_brand FROM pr), x AS (SELECT '.' AS folder, p_size FROM f UNION ALL SELECT 'pkg', p_size FROM f UNION ALL SELECT 'pkg/src', p_size FROM f UNION ALL SELECT 'pkg/src/' || lower(p_type), p_size FROM f UNION ALL SELECT 'pkg/src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')), p_size FROM f) SELECT folder, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS loc, count(*) AS defs FROM x GROUP BY folder")
def a21_rollup(spark, d):
    return views.rollup(_located(spark, d).select("path", F.col("p_size").cast("bigint").alias("loc"), F.lit(1).cast("bigint").alias("defs")))


@query(f"WITH {B.PART_RANKS}, f AS (SELECT p_type, p_brand, rank FROM pr), x AS (SELECT '.' AS folder, rank FROM f UNION ALL SELECT 'pkg', rank FROM f UNION ALL SELECT 'pkg/src', rank FROM f UNION ALL SELECT 'pkg/src/' || lower(p_type), rank FROM f UNION ALL SELECT 'pkg/src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')), rank FROM f) SELECT folder, max(rank) AS rank FROM x GROUP BY folder")
def a30_propagate_max(spark, d):
    return views.propagate_max(_located(spark, d))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def a21_rollup_levels(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_KINDS = "CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'constant' ELSE 'variable' END"


def _typed(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("class", "function", "method", "constant", "variable"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_brand").alias("rel_fname"), F.col("p_name").alias("name"), F.lit("def").alias("kind"), kind.alias("node_type"), F.when(F.col("p_partkey") % 15 == 1, F.lit("Owner")).alias("parent_name"))


_COUNTS = f"WITH k AS (SELECT p_brand AS rel_fname, {_KINDS} AS t, p_partkey % 15 = 1 AS owned FROM part), c AS (SELECT rel_fname, count(*) FILTER (t = 'class') AS classes, count(*) FILTER (t = 'function' AND NOT owned) AS functions, count(*) FILTER (t = 'method' OR (t = 'function' AND owned)) AS methods, count(*) FILTER (t IN ('constant', 'variable')) AS constants, count(*) FILTER (t = 'function' AND owned) AS owned FROM k GROUP BY 1)"


@query(_COUNTS + " SELECT rel_fname, classes, functions, methods, constants FROM c")
def a24_category_counts(spark, d):
    return views.category_counts(_typed(spark, d))


@query(_COUNTS + " SELECT rel_fname, classes, functions, owned AS methods, constants, 3 * classes + 2 * functions + owned + constants AS score FROM c WHERE rel_fname <> 'Brand#1' ORDER BY score DESC, rel_fname LIMIT 30")
def a23_overflow(spark, d):
    return views.overflow(_typed(spark, d), spark.createDataFrame([("Brand#1",)], "rel_fname string"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x) <> '')) AS BIGINT) AS loc FROM documents")
def a19_lines_of_code(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.lines_of_code(F.col("text")).cast("bigint").alias("loc"))


@query("""WITH r AS (SELECT doc_id, text, string_split(text, chr(10)) AS rows FROM documents),
 s AS (SELECT *, greatest(1, CAST(floor(len(rows) / 100.0) AS INTEGER)) AS step FROM r),
 p AS (SELECT doc_id, text, array_to_string(list_filter(rows, lambda x, i: (i - 1) % step = 0), chr(10)) AS picked FROM s)
SELECT doc_id, CASE WHEN length(text) < 200 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE CAST(floor(length(text) * ceil(length(picked) / 4.0) / greatest(length(picked), 1)) AS BIGINT) END AS sampled,
 CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM p""")
def x42_token_estimate(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.sampled_tokens(t).alias("sampled"), text.token_estimate(t).alias("tokens"))


# --- names, paths, search ------------------------------------------------------------------------------------------

_URL_PATH = "regexp_extract(url, '^[^:]+://[^/]+/([^?#]*)', 1)"


def _paths(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.regexp_extract("url", r"^[^:]+://[^/]+/([^?#]*)", 1).alias("path"))


@query(f"WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages), s AS (SELECT page_id, path, length(path) - length(replace(path, '/', '')) AS depth FROM p) SELECT page_id, CAST(depth AS INTEGER) AS depth, CASE WHEN depth <= 2 THEN 1.0 WHEN depth <= 4 THEN 0.5 ELSE 0.1 END::DOUBLE AS weight, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]+$', '') ELSE 'root' END AS folder, lower(regexp_extract(path, '\\.[^./]+$', 0)) AS extension, regexp_extract(path, '[^/]*$', 0) AS base FROM s")
def f06_paths(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("page_id", paths.depth(p).alias("depth"), paths.depth_weight(p).alias("weight"), paths.parent_dir(p).alias("folder"), paths.extension(p).alias("extension"), text.basename(p).alias("base"))


_EXAMPLES = ("src/a.py", "vendors_list.py", "a/node_modules/x.js", "a/b/c/d/e.md", "a/b/c/d/e/f.MD", "docs/guide.md", ".github/workflows/ci.yml", "lib/core/util/x.go", "/root/repo/main.py", "README.md", "pkg/tests/unit/deep/test_x.py")
_VALUES = "(VALUES " + ", ".join(f"('{p}')" for p in _EXAMPLES) + ") v(path)"


@query(f"SELECT path, regexp_matches(path, 'node_modules|vendor|third_party|torchhub|__pycache__|site-packages') AS vendor, regexp_matches(lower(path), '\\.(md|markdown|mdown|mkd)$') AS markdown, CASE WHEN starts_with(path, '/root/repo/') THEN substr(path, 12) ELSE path END AS relative, CASE WHEN regexp_matches(path, 'node_modules|vendor') THEN 0.01 WHEN length(path) - length(replace(path, '/', '')) <= 2 THEN 1.0 WHEN length(path) - length(replace(path, '/', '')) <= 4 THEN 0.5 ELSE 0.1 END::DOUBLE AS weight FROM {_VALUES}")
def f05_path_predicates(spark, d):
    p = F.col("path")
    return spark.createDataFrame([(x,) for x in _EXAMPLES], "path string").select("path", paths.is_vendor(p).alias("vendor"), paths.is_markdown(p).alias("markdown"), paths.relative(p, "/root/repo").alias("relative"), paths.depth_weight(p).alias("weight"))


@query()
def x33_cluster_keys(spark, d):
    p = F.col("path")
    return spark.createDataFrame([(x,) for x in _EXAMPLES], "path string").select("path", paths.cluster_key(p).alias("cluster"), paths.is_important(p).alias("important"), paths.looks_like_path(p).alias("path_like"), paths.is_hidden(p).alias("hidden"))


_FOLDERS = ("", "docs/", ".github/", ".github/workflows/", "src/", "src/docs/")
_NAMES = (*paths.IMPORTANT, "index.rst", "ci.yaml", "notes.txt", "main.py", "mypy.toml")
_PICKED = f"list_value({', '.join(map(repr, _FOLDERS))})[1 + page_id % {len(_FOLDERS)}] || list_value({', '.join(map(repr, _NAMES))})[1 + (page_id // {len(_FOLDERS)}) % {len(_NAMES)}]"


@query(f"""SELECT page_id, path, regexp_extract(path, '[^/]*$') IN ({', '.join(map(repr, paths.IMPORTANT))})
 OR (starts_with(path, 'docs/') AND (suffix(path, '.md') OR suffix(path, '.rst') OR suffix(path, '.txt')))
 OR (starts_with(path, '.github/') AND NOT contains(path[9:], '/') AND (suffix(path, '.md') OR suffix(path, '.yml') OR suffix(path, '.yaml')))
 OR (starts_with(path, '.github/workflows/') AND (suffix(path, '.yml') OR suffix(path, '.yaml'))) AS important
FROM (SELECT page_id, {_PICKED} AS path FROM pages)""")
def f10_important(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    page = F.col("page_id")
    path = F.concat(pick(_FOLDERS, page), pick(_NAMES, F.floor(page / len(_FOLDERS))))
    return table(spark, d, "pages", "page_id").select("page_id", path.alias("path")).withColumn("important", paths.is_important(F.col("path")))


@query(f"""WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages), f AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p),
 g AS (SELECT page_id, path, parts[1:len(parts) - 1] AS folders FROM f),
 h AS (SELECT *, list_min(list_filter([list_position(folders, 'src'), list_position(folders, 'lib'), list_position(folders, 'tests'), list_position(folders, 'app')], lambda x: x > 0)) AS anchor FROM g),
 k AS (SELECT *, CASE WHEN anchor IS NOT NULL AND len(folders) > anchor THEN folders[anchor + 1:anchor + 2] ELSE folders[greatest(len(folders) - 1, 1):] END AS used FROM h)
SELECT page_id, CASE WHEN len(folders) = 0 OR array_to_string(used, '/') = '' THEN '(root)' ELSE array_to_string(used, '/') END AS cluster,
 regexp_matches(path, '\\.(py|js|ts|jsx|tsx|java|go|rs|md)$') AS path_like FROM k""")
def x33_cluster_paths(spark, d):
    path = F.regexp_extract("url", "^[^:]+://[^/]+/([^?#]*)", 1)
    return table(spark, d, "pages", "page_id", "url").select("page_id", paths.cluster_key(path).alias("cluster"), paths.looks_like_path(path).alias("path_like"))


@query("SELECT DISTINCT p_name, contains(lower(p_name), 'ring') OR list_has_any(string_split_regex(lower('ring small'), '[_\\s]+'), regexp_extract_all(replace(lower(p_name), '_', ''), '[a-z]+')) OR list_has_all(string_split_regex(lower(p_name), '[_\\s]+'), ['ring', 'small']) AS hit FROM part")
def f08_focus_match(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part", "p_name").distinct().select("p_name", (text.matches_query(n, F.lit("ring")) | text.matches_query(n, F.lit("ring small"))).alias("hit"))


@query("SELECT p_partkey, p_name, instr(lower(p_name), 'ed') - 1 AS place FROM part WHERE contains(lower(p_name), 'ed') ORDER BY place, p_brand, p_partkey LIMIT 50")
def f09_search(spark, d):
    tags = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("def").alias("kind"), F.col("p_brand").alias("rel_fname"), F.col("p_partkey").alias("line"))
    return context.search(tags, "ED").select(F.col("line").alias("p_partkey"), F.col("name").alias("p_name"), text.position(F.col("name"), "ed").alias("place"))


@query("SELECT DISTINCT p_brand AS file FROM part WHERE contains(lower(p_name), 'ring')")
def g14_focus_resolution(spark, d):
    tags = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("def").alias("kind"), F.col("p_brand").alias("rel_fname"), F.col("p_brand").alias("fname"))
    return context.resolve_focus(tags, ["ring"])[0]


@query("SELECT DISTINCT p_name, len(string_split_regex(lower(p_name), '[_\\s]+')) AS parts, array_to_string(regexp_extract_all(replace(lower(p_name), '_', ''), '[a-z]+'), '|') AS runs, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short, split_part(p_name, ' ', 1) AS head FROM part")
def x22_name_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part", "p_name").distinct().select("p_name", F.size(text.name_parts(n)).cast("bigint").alias("parts"), F.array_join(text.letter_runs(n), "|").alias("runs"), text.ellipsis(n, 8).alias("short"), F.substring_index(n, " ", 1).alias("head"))


_REQUESTS = ("fix this error", "handle the exception", "debug this issue", "refactor this module", "add new feature", "", "show the list", "why is it broken", "optimize and simplify", "add support, fix bug", "nothing here")
_ANY = "(VALUES " + ", ".join(f"('{r}')" for r in _REQUESTS) + ") v(t)"
_SCORES = ", ".join("(" + " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in groups) + f") AS s_{name}" for name, groups in scoring.INTENTS)


@query(f"WITH s AS (SELECT t, {_SCORES} FROM {_ANY}), b AS (SELECT *, greatest(s_debug, s_extend, s_refactor, s_explore) AS m FROM s), i AS (SELECT t, CASE WHEN m = 0 THEN 'explore' WHEN s_debug = m THEN 'debug' WHEN s_extend = m THEN 'extend' WHEN s_refactor = m THEN 'refactor' ELSE 'explore' END AS intent FROM b) SELECT t AS text, intent, CASE intent WHEN 'debug' THEN 1.5 WHEN 'extend' THEN 1.2 WHEN 'refactor' THEN 0.8 ELSE 1.0 END::DOUBLE AS recency, CASE intent WHEN 'debug' THEN 0.8 WHEN 'extend' THEN 0.5 WHEN 'refactor' THEN 2.0 ELSE 1.0 END::DOUBLE AS churn, CASE intent WHEN 'debug' THEN 2.0 WHEN 'extend' THEN 0.7 ELSE 1.0 END::DOUBLE AS reverse FROM i")
def x18_intents(spark, d):
    rows = spark.createDataFrame([(r,) for r in _REQUESTS], "text string").withColumn("intent", scoring.intent(F.col("text")))
    return rows.withColumn("r", scoring.recipe(F.col("intent"))).select("text", "intent", "r.recency", "r.churn", "r.reverse")


@query("SELECT o_orderkey, CAST(age AS BIGINT) AS age, round(CASE WHEN age <= 0 THEN 2.0 ELSE 1 + exp(-age / 30.0) END, 6) AS recency, round(CASE WHEN k <= 5 THEN 1.0 ELSE least(1 + ln(1 + k - 5) * 0.1, 1.5) END, 6) AS churn FROM (SELECT o_orderkey, floor((epoch_us(TIMESTAMP '2001-08-02 12:00:00') - epoch_us(o_orderdate)) / 86400000000) AS age, o_orderkey % 400 AS k FROM orders)")
def x01_factors(spark, d):
    age = scoring.elapsed_days(F.lit("2001-08-02 12:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", age.alias("age"), (F.col("o_orderkey") % 400).alias("k"))
    return rows.select("o_orderkey", "age", F.round(scoring.recency_factor(F.col("age")), 6).alias("recency"), F.round(scoring.churn_factor(F.col("k")), 6).alias("churn"))


# --- boosts, cache, sets -------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT p_brand, p_name, p_partkey, p_size / 100.0 AS base, CASE WHEN p_name LIKE 'red %' THEN 10 ELSE 1 END * CASE WHEN p_brand = 'Brand#2' THEN 5 ELSE 1 END * CASE WHEN p_brand = 'Brand#3' THEN 20 ELSE 1 END * CASE WHEN p_brand = 'Brand#4' THEN 3 ELSE 1 END AS boost, CASE WHEN p_brand = 'Brand#5' THEN 1.5 ELSE 1 END AS weight, CASE WHEN p_brand = 'Brand#6' THEN 2 ELSE 1 END AS caller FROM part) SELECT p_partkey, round(base * boost * weight * caller, 6) AS rank FROM t")
def x06_boost_chain(spark, d):
    part = table(spark, d, "part")
    tags = part.select(F.col("p_brand").alias("rel_fname"), F.concat_ws("#", "p_name", "p_partkey").alias("name"), "p_partkey", "p_name")
    symbols = tags.join(part.select(F.col("p_partkey").alias("k"), "p_size"), F.col("p_partkey") == F.col("k")).select(F.col("rel_fname").alias("file"), F.col("name").alias("symbol"), (F.col("p_size") / 100.0).alias("rank"))
    ranks = part.select(F.col("p_brand").alias("file")).distinct().withColumn("file_rank", F.lit(0.5))
    one = lambda v: spark.createDataFrame([(v,)], "file string")
    idents = tags.where(F.col("p_name").startswith("red ")).select("name")
    weights = one("Brand#5").withColumn("weight", F.lit(1.5))
    out = context.boosted(tags, ranks, symbols, idents=idents, files=one("Brand#2"), focus=one("Brand#3"), mates=one("Brand#4"), weights=weights, caller_files=one("Brand#6"), bias=2.0)
    return out.select("p_partkey", F.round("rank", 6).alias("rank"))


@query("SELECT o_orderkey AS path, o_orderkey % 3 = 0 AS stale FROM orders")
def j09_cache_split(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    cached = now.withColumn("modified", F.when(F.col("path") % 3 == 0, F.col("modified") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modified")))
    hits, misses = cache.split(now, cached)
    return hits.select("path", F.lit(False).alias("stale")).unionByName(misses.select("path", F.lit(True).alias("stale")))


@query("SELECT c_custkey AS path, c_custkey NOT IN (SELECT o_custkey FROM orders) AS excluded FROM customer")
def s07_exclusions(spark, d):
    found, lost = files.tracked(table(spark, d, "customer").select(F.col("c_custkey").alias("path")), table(spark, d, "orders").select(F.col("o_custkey").alias("path")).distinct())
    return found.select("path", F.lit(False).alias("excluded")).unionByName(lost.select("path", F.lit(True).alias("excluded")))


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def e01_set_operations(spark, d):
    a = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.exceptAll(b), "except"))


@query("SELECT p_partkey, list_has_all(string_split(p_name, ' '), ['red']) AS subset, list_has_any(string_split(p_name, ' '), ['red', 'small']) AS overlap, array_to_string(list_sort(string_split(p_name, ' '))[1:1], ',') AS head FROM part")
def x48_array_functions(spark, d):
    parts = F.split("p_name", " ")
    given = lambda *v: F.array(*map(F.lit, v))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", (F.size(F.array_except(given("red"), parts)) == 0).alias("subset"), F.arrays_overlap(parts, given("red", "small")).alias("overlap"), F.array_join(F.slice(F.sort_array(parts), 1, 1), ",").alias("head"))


# --- text, extraction, rendering, export ---------------------------------------------------------------------------

_MARKDOWN = "# Title #####\n\nSome *bold* text with `code` and a [link](http://x).\n\n## Part A\nalpha\n```\n# not a header\n```\n### Deep\nmore\n## Part B\n~~~\n## nor this\n~~~\n# Second\n"
_CODE = '''
LIMIT = 3


def top(a: int, *rest, flag: bool = False, **more) -> str:
    return helper(a)


class Greeter:
    name: str
    callback: Callable[[int], str]

    @property
    def loud(self) -> bool:
        return top(1)

    def greet(self, who):
        def inner():
            return top(who)
        return inner()


def helper(x):
    return x
'''


def _sources(spark):
    return spark.createDataFrame([("/r/a.py", "a.py", _CODE), ("/r/doc.md", "doc.md", _MARKDOWN), ("/r/bad.py", "bad.py", "def (:"), ("/r/none.py", "none.py", ""), ("/r/x.zig", "x.zig", "fn a()")], "path string, rel string, text string")


@query()
def u01_extracted_tags(spark, d):
    got = extract.tags(_sources(spark))
    return got.select("rel_fname", "line", "name", "kind", "node_type", "parent_name", "parent_line", text.render_signature(F.col("signature"), F.lit(HIGH)).alias("signature"), F.array_join(F.transform("fields", lambda f: text.render_field(f, F.lit(MEDIUM))), ", ").alias("fields"))


@query()
def x25_markdown_headers(spark, d):
    rows = spark.createDataFrame([(1, _MARKDOWN)], "id int, text string").select("id", F.posexplode(text.headers(F.col("text"))).alias("seq", "line"))
    return rows.select("id", "seq", text.header_level(F.col("line")).alias("level"), text.header_title(F.col("line")).alias("title"))


@query()
def j15_depths(spark, d):
    return views.depths(extract.tags(_sources(spark)))


@query()
def r02_directory_rows(spark, d):
    tags = extract.tags(_sources(spark)).where("kind = 'def'")
    return views.rendered(tags, F.lit(HIGH)).select("rel_fname", "line", "shown")


@query()
def g13_graph_nodes(spark, d):
    edges = durable(graph.symbol_edges(B.symbol_tags(spark, d)))
    ranks = durable(graph.symbol_pagerank(edges, iterations=_SYMBOL_STEPS))
    return rounded(export.nodes(ranks, edges, bridges=graph.bridges(graph.collapse(edges)), api=graph.surface(edges)), "rank", digits=7)


@query(f"WITH {B.SYMBOL_EDGES} SELECT src_file || ':' || src_sym AS source, dst_file || ':' || dst_sym AS target, CAST(n AS BIGINT) AS weight FROM sedges")
def a06_graph_links(spark, d):
    return export.links(graph.symbol_edges(B.symbol_tags(spark, d)))


@query(f"WITH {B.TAGS} SELECT count(*) FILTER (kind = 'def') AS definition_matches, count(*) FILTER (kind = 'ref') AS reference_matches, count(DISTINCT rel_fname) AS total_files_considered FROM tags")
def s20_report(spark, d):
    return export.report(B.tags(spark, d)).drop("excluded")


@query()
def g16_diagnostics(spark, d):
    edges = durable(graph.file_edges(B.tags(spark, d)))
    return export.diagnostics(graph.vertices(edges), edges, _file_ranks(spark, d))


_LOG = ["2024-01-02T03:04:05+00:00|a@x", "", "src/a.py", "src/b.py", "", "2024-01-03T00:00:00Z|b@y", "src/a.py"]


@query("SELECT * FROM (VALUES ('2024-01-02 03:04:05', 'a@x', 'src/a.py'), ('2024-01-02 03:04:05', 'a@x', 'src/b.py'), ('2024-01-03 00:00:00', 'b@y', 'src/a.py')) v(ts, author, file)")
def s10_log_parse(spark, d):
    lines = spark.createDataFrame([("log", i, x) for i, x in enumerate(_LOG)], "log string, seq int, line string")
    return logs.parse_stats_log(lines).select(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("ts"), "author", "file")


@query("SELECT o_orderkey, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k, event_type FROM (SELECT event_id AS o_orderkey, props, event_type FROM events)")
def x51_json(spark, d):
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, d, "events", "event_id", "props", "event_type").select(F.col("event_id").alias("o_orderkey"), parsed["k"].alias("k"), "event_type")


# --- graph of pages: hosts, their second and third path parts ------------------------------------------------------

_PAGE_EDGES = """u AS (SELECT regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[^:]+://[^/]+/([^/?#]+)', 1) AS lang FROM pages),
 edges AS (SELECT lang AS src, regexp_extract(host, '[^.]*$', 0) AS dst FROM u UNION SELECT regexp_extract(host, '[^.]*$', 0), host FROM u UNION SELECT host, lang FROM u)"""


def _page_edges(spark, d):
    """A language leads to the suffixes it is used under, a suffix to its hosts, a host to its languages."""
    url = table(spark, d, "pages", "url").select(F.regexp_extract("url", "^[^:]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[^:]+://[^/]+/([^/?#]+)", 1).alias("lang"))
    rows = url.distinct().withColumn("suffix", F.substring_index("host", ".", -1))
    pairs = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("lang", "suffix"), ("suffix", "host"), ("host", "lang"))))
    return rows.select(F.explode(pairs).alias("e")).select("e.*").distinct().withColumn("weight", F.lit(1).cast("bigint"))


def _between(steps: int) -> str:
    """SQL of betweenness over ``edges``: the shortest walks between two vertices are their shortest paths."""
    return f"""v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), arcs AS (SELECT DISTINCT src, dst FROM edges),
 walks(d, s, t, k) AS (SELECT 0, id, id, 1.0::DOUBLE FROM v UNION ALL SELECT d + 1, s, dst, sum(k) FROM walks JOIN arcs ON t = src WHERE d < {steps} GROUP BY d, s, dst),
 sp AS (SELECT s, t, min(d) AS d, arg_min(k, d) AS k FROM walks GROUP BY s, t),
 bt AS (SELECT v.id, coalesce((SELECT sum(a.k * b.k / c.k) FROM sp a JOIN sp b ON a.t = b.s JOIN sp c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.t = v.id AND a.s <> v.id AND b.t <> v.id AND a.s <> b.t), 0)
  / (((SELECT count(*) FROM v) - 1.0) * ((SELECT count(*) FROM v) - 2)) AS betweenness FROM v)"""


# in this graph a vertex is reached over at most two rounds of three arcs
_PAGE_BETWEEN = f"WITH RECURSIVE {_PAGE_EDGES}, {_between(9)}"


@query(_PAGE_BETWEEN + " SELECT id, round(betweenness, 6) AS betweenness FROM bt")
def g05_betweenness_pages(spark, d):
    return rounded(graph.betweenness(_page_edges(spark, d)), "betweenness")


@query(
    _PAGE_BETWEEN
    + """, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM arcs UNION ALL SELECT dst FROM arcs) GROUP BY id),
 nb AS (SELECT src AS id, dst AS other FROM arcs UNION SELECT dst, src FROM arcs),
 two AS (SELECT id, string_agg(other, ',' ORDER BY k) AS connects FROM (SELECT nb.id, other, row_number() OVER (PARTITION BY nb.id ORDER BY degree DESC, other) AS k FROM nb JOIN dg ON dg.id = other) WHERE k <= 2 GROUP BY id)
SELECT b.id, round(betweenness, 6) AS betweenness, connects FROM (SELECT * FROM bt ORDER BY round(betweenness, 9) DESC, id LIMIT 5) b JOIN two ON two.id = b.id WHERE betweenness > 0"""
)
def g06_bridges_pages(spark, d):
    return rounded(graph.bridges(_page_edges(spark, d)), "betweenness").select("id", "betweenness", F.array_join("connects", ",").alias("connects"))


@query(_PAGE_BETWEEN + " SELECT round(max(betweenness), 6) AS highest, round(avg(betweenness), 6) AS mean, count(*) FILTER (betweenness = 0) AS zeros FROM bt")
def a28_betweenness_summary(spark, d):
    return rounded(graph.betweenness_summary(graph.betweenness(_page_edges(spark, d))), "highest", "mean")


# --- history, files and marks --------------------------------------------------------------------------------------


@query(
    _STATS
    + " , w AS (SELECT file, CASE WHEN quiet <= 0 THEN 2.0 ELSE 1 + exp(-quiet / 30.0) END * CASE WHEN commits <= 5 THEN 1.0 ELSE least(1 + ln(1 + commits - 5) * 0.1, 1.5) END AS weight FROM a) SELECT file, round(weight, 6) AS weight FROM w WHERE weight > 1 ORDER BY w.weight DESC, file LIMIT 10"
)
def o14_top_boosted(spark, d):
    return rounded(history.boosted(history.file_weights(*_order_stats(spark, d))).select("file", "weight"), "weight")


@query("SELECT c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j17_without_chat(spark, d):
    return files.without_chat(table(spark, d, "customer").select(F.col("c_custkey").alias("path")), table(spark, d, "orders").select(F.col("o_custkey").alias("path")))


@query("SELECT c_custkey AS path FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def s13_working_set(spark, d):
    return files.working_set(*(table(spark, d, t).select(F.col(c).alias("path")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey"))))


@query(
    "WITH f AS (SELECT p_brand AS file, min(p_partkey) % 3 / 10000.0 AS r FROM part GROUP BY 1) SELECT p_partkey, round(CASE WHEN p_name LIKE 'red %' THEN 10 ELSE 1 END * r, 6) AS rank FROM part JOIN f ON file = p_brand WHERE r > 1.00001e-4"
)
def f07_exclude_unranked(spark, d):
    part = table(spark, d, "part")
    tags = part.select(F.col("p_brand").alias("rel_fname"), F.col("p_name").alias("name"), "p_partkey")
    ranks = part.groupBy(F.col("p_brand").alias("file")).agg((F.min("p_partkey") % 3 / 10000.0).alias("file_rank"))
    none = spark.createDataFrame([], "file string")
    out = context.boosted(tags, ranks, idents=tags.where("name like 'red %'").select("name"), files=none, focus=none, mates=none, exclude_unranked=True)
    return rounded(out, "rank").select("p_partkey", "rank")


_MARKS = ("Brand#2", "Brand#7"), ("Brand#3", "Brand#7")


@query(
    f"SELECT p_partkey, p_brand IN {_MARKS[0]!r} AS bridge, p_size > 25 AS api, CASE WHEN p_brand IN {_MARKS[1]!r} THEN 'crystal' END AS phase, CASE WHEN p_brand = 'Brand#7' THEN 'recent,high-churn' END AS badges FROM part"
)
def j16_annotated(spark, d):
    part = table(spark, d, "part")
    tags = part.select("p_partkey", F.col("p_brand").alias("rel_fname"), F.col("p_partkey").cast("string").alias("name"))
    one = lambda names, **more: spark.createDataFrame([(n,) for n in names], "file string").withColumns(more)
    api = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("string").alias("symbol"), F.when(F.col("p_size") > 25, "api").otherwise("unknown").alias("label"))
    badges = one(["Brand#7"], badges=F.array(F.lit("recent"), F.lit("high-churn")))
    out = views.annotate(tags, bridges=one(_MARKS[0]).withColumnRenamed("file", "id"), api=api, phases=one(_MARKS[1], phase=F.lit("crystal")), badges=badges)
    return out.select("p_partkey", "bridge", "api", "phase", F.array_join("badges", ",").alias("badges"))


_OWNERS = "t AS (SELECT p_brand AS rel_fname, string_split(p_name, ' ')[1] AS word, p_name || p_partkey AS name, p_partkey % 3 = 0 AS is_class FROM part)"


@query(f"WITH {_OWNERS}, c AS (SELECT DISTINCT rel_fname, word FROM t WHERE is_class) SELECT rel_fname, word AS class, string_agg(DISTINCT name, ',' ORDER BY name) AS methods FROM t JOIN c USING (rel_fname, word) WHERE NOT is_class GROUP BY ALL")
def j18_methods_of(spark, d):
    word, is_class = F.split("p_name", " ")[0], F.col("p_partkey") % 3 == 0
    name = F.when(is_class, word).otherwise(F.concat("p_name", F.col("p_partkey").cast("string")))
    tags = table(spark, d, "part").select(F.col("p_brand").alias("rel_fname"), name.alias("name"), F.lit("def").alias("kind"), F.when(is_class, "class").otherwise("method").alias("node_type"), F.when(~is_class, word).alias("parent_name"))
    return views.methods_of(tags).select("rel_fname", "class", F.array_join("methods", ",").alias("methods"))


@query(
    """WITH RECURSIVE t AS (SELECT c_mktsegment AS rel_fname, c_custkey AS line, c_custkey // 2 AS parent FROM customer),
 up(rel_fname, line, above, depth) AS (
  SELECT rel_fname, line, parent, CASE WHEN parent > 0 THEN 1 ELSE 0 END FROM t
  UNION ALL SELECT up.rel_fname, up.line, t.parent, depth + CASE WHEN t.parent > 0 THEN 1 ELSE 0 END FROM up JOIN t ON t.rel_fname = up.rel_fname AND t.line = up.above AND up.above > 0)
SELECT rel_fname, line, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY 1, 2"""
)
def j15_depths_customers(spark, d):
    """Customers of a segment lie below the one of half their number, if that is of the segment, too."""
    key = F.col("c_custkey")
    return views.depths(table(spark, d, "customer").select(F.col("c_mktsegment").alias("rel_fname"), key.alias("line"), F.floor(key / 2).alias("parent_line"), F.lit("def").alias("kind")))


# --- listings of documents -----------------------------------------------------------------------------------------

_LOC = "CAST(len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x) <> '')) AS BIGINT)"
_SIZES = f"sizes AS (SELECT source || '/' || lang || '/' || doc_id AS path, {_LOC} AS loc, doc_id % 4 AS defs FROM documents)"


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel"), "text")


def _document_sizes(spark, d):
    """Documents as files with as many definitions as their id modulo four."""
    rows = _documents(spark, d)
    defs = rows.where("doc_id % 4 > 0").select(F.col("rel").alias("rel_fname"), F.explode(F.sequence(F.lit(1), F.col("doc_id") % 4)), F.lit("def").alias("kind"))
    return views.file_sizes(rows, defs)


@query(f"WITH {_SIZES} SELECT * FROM sizes")
def a20_file_sizes(spark, d):
    return _document_sizes(spark, d)


@query(f"WITH {_SIZES} SELECT printf('%5d loc; %3d def  %s', loc, defs, path) AS line FROM sizes ORDER BY CASE WHEN loc % 7 > 0 THEN loc % 7 END DESC NULLS LAST, path LIMIT 500")
def r04_stats_lines(spark, d):
    sizes = _document_sizes(spark, d)
    ranks = sizes.where("loc % 7 > 0").select(F.col("path").alias("rel_fname"), (F.col("loc") % 7).alias("max_rank"))
    return views.stats_lines(sizes, ranks)


@query(
    f"""WITH {_SIZES}, s AS (SELECT *, string_split(path, '/') AS p FROM sizes),
 one AS (SELECT p[1] AS a, count(*) AS n, sum(loc) AS loc, sum(defs) AS defs FROM s GROUP BY 1), two AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n, sum(loc) AS loc, sum(defs) AS defs FROM s GROUP BY 1, 2),
 lines AS (SELECT a AS a, NULL AS b, NULL AS c, a || '/ ' || n || ' files; ' || loc || ' loc; ' || defs || ' def' AS line FROM one
  UNION ALL SELECT a, b, NULL, '  ' || b || '/ ' || n || ' files; ' || loc || ' loc; ' || defs || ' def' FROM two
  UNION ALL SELECT p[1], p[2], p[3], '    ' || p[3] || ' ' || loc || ' loc; ' || defs || ' def' FROM s)
SELECT row_number() OVER (ORDER BY lower(a) NULLS FIRST, lower(b) NULLS FIRST, c NULLS FIRST) AS place, line FROM lines"""
)
def o10_stats_tree(spark, d):
    return ordering.placed(views.stats_tree(_document_sizes(spark, d)), F.col("seq")).select((F.col("place") + 1).cast("bigint").alias("place"), "line")


@query(
    r"""SELECT rel_fname, CAST(line AS BIGINT) AS line, regexp_replace(string_split(text, chr(10))[line], ':\s*$', '') AS code
FROM (SELECT source || '/' || lang || '/' || doc_id AS rel_fname, text, unnest([1, 1 + doc_id % 9]) AS line FROM documents) WHERE line <= len(string_split(text, chr(10))) GROUP BY ALL"""
)
def r03_tree_lines(spark, d):
    rows = _documents(spark, d)
    wanted = rows.select(F.col("rel").alias("rel_fname"), F.explode(F.array(F.lit(1).cast("bigint"), F.col("doc_id") % 9 + 1)).alias("line"))
    return views.tree_lines(rows, wanted).select("rel_fname", F.col("line").cast("bigint").alias("line"), "code")


@query(
    """WITH t AS (SELECT source || '/' || lang || '/' || doc_id AS rel_fname, 1 + doc_id % 9 AS line, string_split(text, chr(10)) AS rows FROM documents),
 n AS (SELECT rel_fname, line, unnest(range(greatest(1, line - 2), least(len(rows), line + 2) + 1)) AS i, rows FROM t)
SELECT rel_fname, CAST(line AS BIGINT) AS line, string_agg(printf('%4d: %s', i, rows[i]), chr(10) ORDER BY i) AS context FROM n GROUP BY 1, 2"""
)
def f17_search_context(spark, d):
    rows = _documents(spark, d)
    hits = rows.select(F.col("rel").alias("rel_fname"), (F.col("doc_id") % 9 + 1).cast("bigint").alias("line"), F.lit("x").alias("name"), F.lit("def").alias("kind"))
    return context.search_context(hits, rows).select("rel_fname", "line", "context")


@query(
    """SELECT source || '/' || lang || '/' || doc_id AS path, repeat('=', 80) || chr(10) || source || '/' || lang || '/' || doc_id || chr(10) || repeat('=', 80) || chr(10) || text || chr(10) AS block FROM documents WHERE text IS NOT NULL"""
)
def o13_concatenated(spark, d):
    return files.concatenated(_documents(spark, d).withColumnRenamed("rel", "path"))


@query("SELECT doc_id, length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) + 1 AS line FROM documents")
def x29_line_of(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.line_of(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("bigint").alias("line"))


# --- markdown ------------------------------------------------------------------------------------------------------

#: Every sixth line of a document becomes a header, a fenced block with a false header goes into every second gap.
_MARKED = """ln AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, n, unnest(range(n)) AS i FROM ln),
 hd AS (SELECT doc_id, i, 1 + (i // 6 * 5) % 4 AS level, 'Head ' || i AS title FROM l WHERE i % 6 = 0 UNION ALL SELECT doc_id, i, 1, 'no header' FROM l WHERE i % 12 = 9 AND i + 1 = n)"""


def _marked_documents(spark, d):
    at = lambda i: (F.floor(i / 6).cast("int") * 5) % 4 + 1
    line = lambda x, i: F.when(i % 6 == 0, F.concat(F.substring(F.lit("####"), F.lit(1), at(i)), F.lit(" Head "), i.cast("string"), F.lit(" ##"))).when(i % 12 == 8, "```").when(i % 12 == 9, "# no header").when(i % 12 == 10, "```").otherwise(x)
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(f"WITH {_MARKED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, CAST(level AS BIGINT) AS level, title FROM hd")
def x25_markdown_documents(spark, d):
    rows = _marked_documents(spark, d).select("doc_id", F.posexplode(text.headers(F.col("text"))).alias("seq", "line"))
    return rows.select("doc_id", F.col("seq").cast("bigint").alias("seq"), text.header_level(F.col("line")).cast("bigint").alias("level"), text.header_title(F.col("line")).alias("title"))


@query(
    f"""WITH {_MARKED}, up AS (SELECT h.doc_id, h.i, max(p.i) AS above FROM hd h LEFT JOIN hd p ON p.doc_id = h.doc_id AND p.i < h.i AND p.level < h.level GROUP BY 1, 2)
SELECT h.doc_id, h.i + 1 AS line, h.title AS name, 'h' || h.level AS node_type, above + 1 AS parent_line, p.title AS parent_name FROM hd h JOIN up USING (doc_id, i) LEFT JOIN hd p ON p.doc_id = up.doc_id AND p.i = up.above"""
)
def j13_markdown_tags(spark, d):
    named = _marked_documents(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("rel"), "text")
    tags = extract.tags(named)
    return tags.select(F.substring_index("rel_fname", ".", 1).cast("bigint").alias("doc_id"), F.col("line").cast("bigint").alias("line"), "name", "node_type", F.col("parent_line").cast("bigint").alias("parent_line"), "parent_name")


@query("SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' and ' || p_name || ' end' AS shown FROM part")
def x27_snippets(spark, d):
    marked = F.concat(F.lit("`"), "p_name", F.lit("`\n  ["), "p_type", F.lit("](http://x/y_z) **"), "p_brand", F.lit("**\n```\n# code\n```\nand  _"), "p_name", F.lit("_ end\n"))
    return table(spark, d, "part").select("p_partkey", text.snippet(marked).alias("shown"))


@query(
    r"""WITH t AS (SELECT p_partkey, rtrim(repeat(p_name || ', ', 1 + p_size % 12), ' ') AS t FROM part)
SELECT p_partkey, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(regexp_replace(left(t, 48), '\s+\S*$', ''), '[\s.,;:!?-]+$', '') || ' [...] ' || regexp_replace(regexp_replace(right(t, 32), '^\S*\s+', ''), '[\s.,;:!?-]+$', '') END AS shown FROM t"""
)
def x28_head_tail(spark, d):
    long = F.rtrim(F.repeat(F.concat("p_name", F.lit(", ")), F.col("p_size") % 12 + 1))
    return table(spark, d, "part").select("p_partkey", text.head_tail(long).alias("shown"))


# --- rendering and decisions ---------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT p_partkey, p_size, p_name, p_type, string_split(p_name, ' ') AS w, 1 + p_size % 3 AS detail FROM part)
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '— "' || p_name || '"' WHEN detail = 1 THEN '...' WHEN detail = 2 THEN '(' || w[1] || ', ' || w[2] || ')' ELSE '(' || w[1] || ': ' || p_type || '[int], ' || w[2] || ')' || CASE WHEN p_size % 2 = 0 THEN ' -> str' ELSE '' END END AS signature,
 w[1] || CASE WHEN detail = 1 OR p_size % 5 = 0 THEN '' WHEN detail = 3 THEN ': ' || p_type || '[int]' ELSE ': ' || p_type END AS field,
 p_name || CASE WHEN p_size % 8 = 0 THEN '' ELSE '(' || array_to_string(list_transform(range(least(p_size % 8, 5)), lambda i: 'f' || i || CASE WHEN detail = 1 THEN '' WHEN detail = 3 THEN ': ' || p_type || '[int]' ELSE ': ' || p_type END), ', ') || CASE WHEN p_size % 8 > 5 THEN ', +' || (p_size % 8 - 5) ELSE '' END || ')' END AS class,
 p_type AS simple FROM w"""
)
def x36_rendered(spark, d):
    size, words, kind = F.col("p_size"), F.split("p_name", " "), F.concat("p_type", F.lit("[int]"))
    none, detail = F.lit(None).cast("string"), size % 3 + 1
    parameter = lambda name, type_: F.struct(name.alias("name"), type_.alias("type"))
    signature = F.struct(F.array(parameter(words[0], kind), parameter(words[1], none)).alias("parameters"), F.when(size % 2 == 0, "str").alias("return_type"), F.when(size % 7 == 0, F.col("p_name")).alias("raw"))
    field = F.struct(words[0].alias("name"), F.when(size % 5 != 0, kind).alias("type_annotation"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: i < size % 8)
    fields = F.transform(numbers, lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("name"), kind.alias("type_annotation")))
    rows = table(spark, d, "part").select("p_partkey", "p_name", signature.alias("s"), field.alias("f"), fields.alias("fs"), detail.alias("detail"), kind.alias("kind"))
    return rows.select(
        "p_partkey",
        text.render_signature(F.col("s"), F.col("detail")).alias("signature"),
        text.render_field(F.col("f"), F.col("detail")).alias("field"),
        text.class_preview(F.col("p_name"), F.col("fs"), F.col("detail")).alias("class"),
        text.simple_type(F.col("kind")).alias("simple"),
    )


@query("SELECT p_partkey, p_size % 3 = 0 OR p_type IN ('ECONOMY', 'SMALL') AS clustered FROM part")
def x20_use_clusters(spark, d):
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("p_size") % 3 + 1).cast("int"))
    pattern = F.when(F.col("p_type") == "ECONOMY", "diffuse").when(F.col("p_type") == "SMALL", "sparse").otherwise("layered")
    return table(spark, d, "part").select("p_partkey", scoring.use_clusters(level, F.array(F.lit("deep"), pattern)).alias("clustered"))


from waymark import scale_queries  # noqa: E402, F401  registers its queries

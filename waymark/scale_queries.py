"""Further queries: code in many languages, and operators made for hot names, wide commits and long logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import bindings as B
from waymark import code_samples
from waymark.bindings import table
from waymark.config import HIGH
from waymark.functions import text
from waymark.operators import context, export, extract, factorised, graph, history, intervals, views
from waymark.queries import ORACLES, query, rounded
from waymark.sources import files
from waymark.sources import history as logs

# --- code ----------------------------------------------------------------------------------------------------------


def _rendered(rows: DataFrame, folder: str, samples: list) -> DataFrame:
    """``path, rel, text`` of a file for each key, in the language of its sample."""
    n, key = len(samples), F.col("k").cast("string")
    chosen = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % n + 1).cast("int"))
    path = F.concat(F.lit(f"{folder}/"), key, chosen([s for s, _, _ in samples]))
    return rows.select(path.alias("path"), path.alias("rel"), F.replace(chosen([t for _, t, _ in samples]), F.lit("{k}"), key).alias("text"))


def code_files(spark, d) -> DataFrame:
    parts = _rendered(table(spark, d, "part").select(F.col("p_partkey").alias("k")), "part", code_samples.SAMPLES)
    return parts.unionByName(_rendered(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "customer", [(".mjs", code_samples.CALLER, None)]))


_CODE = f"""code AS (
 SELECT 'part/' || p_partkey || suffix AS file, line, kind, node_type, replace(name, '{{k}}', p_partkey::VARCHAR) AS name, replace(parent, '{{k}}', p_partkey::VARCHAR) AS parent_name, parent_line
 FROM part JOIN (VALUES {code_samples.values(code_samples.SAMPLES)}) s(sample, suffix, line, kind, node_type, name, parent, parent_line) ON sample = p_partkey % {len(code_samples.SAMPLES)}
 UNION ALL
 SELECT 'customer/' || c_custkey || suffix, line, kind, node_type, replace(name, '{{k}}', c_custkey::VARCHAR), replace(parent, '{{k}}', c_custkey::VARCHAR), parent_line
 FROM customer, (VALUES {code_samples.values([(".mjs", "", code_samples.CALLER_TAGS)])}) s(sample, suffix, line, kind, node_type, name, parent, parent_line))"""


@query(f"WITH {_CODE} SELECT file, CAST(line AS BIGINT) AS line, kind, node_type, name, parent_name, CAST(parent_line AS BIGINT) AS parent_line FROM code")
def u06_code_tags(spark, d):
    found = extract.tags(code_files(spark, d), enclosing=True)
    return found.select(F.col("rel_fname").alias("file"), F.col("line").cast("bigint").alias("line"), "kind", "node_type", "name", "parent_name", F.col("parent_line").cast("bigint").alias("parent_line"))


# --- graphs without edge tables ------------------------------------------------------------------------------------


@query(ORACLES["g01_file_pagerank"])
def g01_factorised_pagerank(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_name").alias("id"))
    weights = graph.personalization(nodes, F.col("id"), ["NATION_7"])
    return rounded(factorised.pagerank(weights, factorised.file_factors(B.tags(spark, d)), iterations=20), "rank")


@query(ORACLES["g02_symbol_pagerank"])
def g02_factorised_symbols(spark, d):
    return rounded(factorised.symbol_pagerank(factorised.symbol_factors(B.symbol_tags(spark, d)), iterations=5), "rank", digits=7)


@query(ORACLES["a03_degrees"])
def a03_factorised_degrees(spark, d):
    return factorised.degrees(table(spark, d, "nation").select(F.col("n_name").alias("id")), factorised.file_factors(B.tags(spark, d)))


@query(ORACLES["a07_density"])
def a07_factorised_density(spark, d):
    return rounded(factorised.density(factorised.file_factors(B.tags(spark, d))), "density")


#: Every customer's file refers to the market segment of its nation's suppliers and to what its own number names; all suppliers define one name.
_HOT = """ht AS (SELECT 'c' || c_custkey AS f, 'init' AS name, 'ref' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, 'init', 'def' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'init', 'ref' FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'ref' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'def' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'def' FROM customer WHERE c_custkey % 3 = 0)"""


def _hot_tags(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    row = lambda df, letter, key, name, kind: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("rel_fname"), name.alias("name"), F.lit(kind).alias("kind"))
    nation = lambda key: F.concat(F.lit("n"), F.col(key).cast("string"))
    parts = [row(c, "c", "c_custkey", F.lit("init"), "ref"), row(s, "s", "s_suppkey", F.lit("init"), "def"), row(s, "s", "s_suppkey", F.lit("init"), "ref"), row(c, "c", "c_custkey", nation("c_nationkey"), "ref")]
    parts += [row(s, "s", "s_suppkey", nation("s_nationkey"), "def"), row(c.where("c_custkey % 3 = 0"), "c", "c_custkey", nation("c_nationkey"), "def")]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {_HOT}, r AS (SELECT DISTINCT f, name FROM ht WHERE kind = 'ref'), df AS (SELECT DISTINCT f, name FROM ht WHERE kind = 'def'), rn AS (SELECT name, count(*) AS n FROM r GROUP BY 1), dn AS (SELECT name, count(*) AS n FROM df GROUP BY 1),
 o AS (SELECT r.f, sum(dn.n) AS o FROM r JOIN dn USING (name) GROUP BY 1), i AS (SELECT df.f, sum(rn.n) AS i FROM df JOIN rn USING (name) GROUP BY 1), l AS (SELECT r.f, count(*) AS w FROM r JOIN df ON df.f = r.f AND df.name = r.name GROUP BY 1), v AS (SELECT DISTINCT f FROM ht)
SELECT v.f AS id, CAST(coalesce(i, 0) - coalesce(w, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) - coalesce(w, 0) AS BIGINT) AS out_degree FROM v LEFT JOIN o ON o.f = v.f LEFT JOIN i ON i.f = v.f LEFT JOIN l ON l.f = v.f"""
)
def j01_hot_name_degrees(spark, d):
    tags = _hot_tags(spark, d)
    return factorised.degrees(tags.select(F.col("rel_fname").alias("id")).distinct(), factorised.file_factors(tags))


# --- wide commits --------------------------------------------------------------------------------------------------


@query(ORACLES["g09_coupling_selective"])
def g09_coupling_pruned(spark, d):
    return rounded(history.coupling(B.touches(spark, d), threshold=0.65, pruned=True), "score")


#: Orders touch the parts of their lines; one commit touches every part, another every second one.
_WIDE = "wt AS (SELECT DISTINCT l_orderkey % 500 AS c, 'p' || l_partkey % 300 AS f FROM lineitem UNION SELECT -1, 'p' || p_partkey % 300 FROM part UNION SELECT -2, 'p' || p_partkey % 300 FROM part WHERE p_partkey % 2 = 0)"


@query(
    f"""WITH {_WIDE}, z AS (SELECT f, count(*) AS n FROM wt GROUP BY f), p AS (SELECT x.f AS a, y.f AS b, count(*) AS together FROM wt x JOIN wt y ON x.c = y.c AND x.f < y.f GROUP BY 1, 2)
SELECT a, b, together, round(together / (za.n + zb.n - together), 6) AS score FROM p JOIN z za ON za.f = a JOIN z zb ON zb.f = b WHERE together / (za.n + zb.n - together) >= 0.1"""
)
def j11_wide_commits(spark, d):
    part = table(spark, d, "part", "p_partkey")
    name = lambda key: F.concat(F.lit("p"), (F.col(key) % 300).cast("string")).alias("file")
    touched = table(spark, d, "lineitem", "l_orderkey", "l_partkey").select((F.col("l_orderkey") % 500).alias("commit_id"), name("l_partkey"))
    for commit, rows in ((-1, part), (-2, part.where("p_partkey % 2 = 0"))):
        touched = touched.unionByName(rows.select(F.lit(commit).cast("bigint").alias("commit_id"), name("p_partkey")))
    return rounded(history.coupling(touched, threshold=0.1, pruned=True), "score")


# --- long logs -----------------------------------------------------------------------------------------------------


def _log(spark, d, head) -> DataFrame:
    """``log, seq, line``: one log of all orders; the head line of each, a blank one and the parts of its lines."""
    orders = table(spark, d, "orders").select("*", (F.col("o_orderkey") * 20).alias("seq"))
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    heads = orders.select("seq", head.alias("line")).unionByName(orders.select(F.col("seq") + 1, F.lit("  ").alias("line")).toDF("seq", "line"))
    lines = heads.unionByName(items.select((F.col("l_orderkey") * 20 + 2 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit(" part/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("line")))
    return lines.select(F.lit("all").alias("log"), "seq", "line").repartition(4)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS author, 'part/' || l_partkey || '.py' AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def s10_orders_log(spark, d):
    head = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("|"), F.col("o_orderpriority"))
    return logs.parse_stats_log(_log(spark, d, head)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "author", "file")


@query("SELECT lpad(o_orderkey::VARCHAR, 40, '0') AS commit_id, 'part/' || l_partkey || '.py' AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def s11_orders_touch_log(spark, d):
    return logs.parse_touch_log(_log(spark, d, F.lpad(F.col("o_orderkey").cast("string"), 40, "0")))


@query("SELECT lpad(o_orderkey::VARCHAR, 40, '0') AS commit_id, o_orderpriority AS author, strftime(o_orderdate, '%Y-%m-%d') AS day, 'order of ' || o_custkey AS subject FROM orders")
def s12_orders_story_log(spark, d):
    o = table(spark, d, "orders")
    four = F.array(F.lpad(F.col("o_orderkey").cast("string"), 40, "0"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")), F.lit(""))
    lines = o.select("o_orderkey", F.posexplode(four).alias("at", "line")).select(F.lit("Order").alias("symbol"), (F.col("o_orderkey") * 10 + F.col("at")).alias("seq"), "line")
    return logs.parse_story_log(lines).select("commit_id", "author", F.date_format("ts", "yyyy-MM-dd").alias("day"), "subject")


# --- positions and intervals ---------------------------------------------------------------------------------------

#: Positions are lines of documents; blocks of three lines, wider ones that hold, touch and cross them, and one that never closes.
_BLOCKS = """ln AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, n, unnest(range(n)) AS i FROM ln),
 iv AS (SELECT doc_id, i AS s, i + 2 AS e FROM l WHERE i % 12 = 8 UNION ALL SELECT doc_id, i, i + 19 FROM l WHERE i % 40 = 5 UNION ALL SELECT doc_id, i, i + 4 FROM l WHERE i % 12 = 10 UNION ALL SELECT doc_id, n - n // 4, NULL FROM ln WHERE doc_id % 3 = 0)"""


def _blocks(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    lines = docs.select(F.col("doc_id").alias("group"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    spans = [lines.where(F.col("at") % m == r).select("group", F.col("at").alias("start"), (F.col("at") + size).alias("end")) for m, r, size in ((12, 8, 2), (40, 5, 19), (12, 10, 4))]
    spans.append(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("group"), (F.col("n") - F.floor(F.col("n") / 4)).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    return lines, reduce(DataFrame.unionByName, spans)


@query(f"WITH {_BLOCKS} SELECT l.doc_id, l.i AS line, count(*) AS blocks, min(s) AS first FROM l JOIN iv ON iv.doc_id = l.doc_id AND s <= i AND (e IS NULL OR i <= e) GROUP BY 1, 2")
def j14_lines_in_blocks(spark, d):
    lines, spans = _blocks(spark, d)
    return intervals.within(lines, spans).groupBy(F.col("group").alias("doc_id"), F.col("at").cast("bigint").alias("line")).agg(F.count(F.lit(1)).alias("blocks"), F.min("start").cast("bigint").alias("first"))


@query(f"WITH {_BLOCKS} SELECT doc_id, i AS line FROM l WHERE i % 6 = 0 AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.doc_id = l.doc_id AND s <= i AND (e IS NULL OR i <= e))")
def j14_headers_outside_blocks(spark, d):
    lines, spans = _blocks(spark, d)
    return intervals.outside(lines.where("at % 6 = 0"), spans).select(F.col("group").alias("doc_id"), F.col("at").cast("bigint").alias("line"))


#: Orders hold their lines, each line the next ones if its supplier is even; parts are nested in one another.
_NESTED = """li AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_suppkey) % 2 AS odd FROM lineitem GROUP BY 1, 2),
 nv AS (SELECT k % 7 AS g, k * 100 + n AS s, CASE WHEN odd = 1 THEN k * 100 + n ELSE k * 100 + 90 - n END AS e, k * 100 + n AS id FROM li
 UNION ALL SELECT o_orderkey % 7, o_orderkey * 100, o_orderkey * 100 + 99, o_orderkey * 100 FROM orders UNION ALL SELECT 100, p_partkey, 100000000 - p_partkey, p_partkey FROM part)"""


def _nested(spark, d) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    items = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").groupBy(k, n).agg((F.max("l_suppkey") % 2).alias("odd"))
    rows = items.select((k % 7).alias("group"), (k * 100 + n).alias("start"), F.when(F.col("odd") == 1, k * 100 + n).otherwise(k * 100 + 90 - n).alias("end"), (k * 100 + n).alias("id"))
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders", "o_orderkey").select((k % 7).alias("group"), (k * 100).alias("start"), (k * 100 + 99).alias("end"), (k * 100).alias("id"))
    k = F.col("p_partkey")
    parts = table(spark, d, "part", "p_partkey").select(F.lit(100).cast("bigint").alias("group"), k.alias("start"), (F.lit(100_000_000) - k).alias("end"), k.alias("id"))
    return rows.unionByName(orders).unionByName(parts)


@query(
    f"""WITH {_NESTED}, k AS (SELECT x.g, x.id, y.id AS parent, row_number() OVER (PARTITION BY x.g, x.id ORDER BY y.s DESC, y.e, y.id DESC) AS r, count(y.id) OVER (PARTITION BY x.g, x.id) AS depth
 FROM nv x LEFT JOIN nv y ON y.g = x.g AND y.s // 100 = x.s // 100 AND x.g < 100 AND y.s <= x.s AND y.e >= x.e AND y.id <> x.id)
SELECT g AS "group", id, CASE WHEN g = 100 AND id > 0 THEN id - 1 ELSE parent END AS parent, CASE WHEN g = 100 THEN id ELSE depth END AS depth FROM k WHERE r = 1"""
)
def u03_nearest_scopes(spark, d):
    return intervals.nearest(_nested(spark, d))


# --- many focus targets, seen types --------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT DISTINCT target FROM (SELECT substr(p_name, 1 + p_partkey % 3, 3 + p_partkey % 5) AS target FROM part UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT substr(p_name, 2, 1 + p_partkey % 2) FROM part
  UNION ALL SELECT split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) FROM part) WHERE trim(target) <> ''),
 n AS (SELECT DISTINCT p_name AS name, p_brand AS file FROM part), q AS (SELECT target FROM t WHERE target NOT IN (SELECT file FROM n)),
 x AS (SELECT target, name, file FROM q, n WHERE contains(lower(name), lower(target)) OR list_has_all(string_split_regex(lower(name), '[_\\s]+'), string_split_regex(lower(target), '[_\\s]+'))
   OR list_has_any(string_split_regex(lower(target), '[_\\s]+'), regexp_extract_all(replace(lower(name), '_', ''), '[a-z]+')))
SELECT target, count(DISTINCT file) AS files, coalesce(max(names), 0) AS names FROM (SELECT target, file, (SELECT count(DISTINCT name) FROM x y WHERE y.target = x.target) AS names FROM x UNION ALL SELECT target, target, NULL FROM t WHERE target IN (SELECT file FROM n)) GROUP BY target"""
)
def j10_many_targets(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    words, key = F.split("p_name", " "), F.col("p_partkey")
    some = [F.substring(F.col("p_name"), 1 + key % 3, 3 + key % 5), F.upper("p_name"), F.col("p_brand"), F.substring(F.col("p_name"), F.lit(2), 1 + key % 2), F.concat(F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit("_"), words[0])]
    targets = part.select(F.explode(F.array(*some)).alias("target"))
    tags = part.select(F.col("p_name").alias("name"), F.lit("def").alias("kind"), F.col("p_brand").alias("rel_fname"), F.col("p_brand").alias("fname"))
    found, named = context.resolve_targets(tags, targets)
    counted = named.groupBy("target").agg(F.count(F.lit(1)).alias("names"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("files")).join(counted, "target", "left").na.fill(0)


@query(
    """WITH a AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, 's' || l_suppkey % 5 AS n1, 'T' || l_partkey % 4 AS t1, 'q' || l_quantity::BIGINT % 3 AS n2, CASE WHEN l_suppkey % 3 > 0 THEN 'int' END AS t2 FROM lineitem),
 p AS (SELECT o, r, 0 AS i, n1 AS n, t1 AS t FROM a UNION ALL SELECT o, r, 1, n2, t2 FROM a), f AS (SELECT *, t IS NOT NULL AND row_number() OVER (PARTITION BY o, n, t ORDER BY r, i) = 1 AS fresh FROM p)
SELECT o AS file, r AS line, '(' || string_agg(CASE WHEN fresh THEN n || ': ' || t ELSE n END, ', ' ORDER BY i) || ')' AS shown FROM f GROUP BY o, r"""
)
def x36_seen_types(spark, d):
    items = table(spark, d, "lineitem")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    named = lambda letter, value: F.concat(F.lit(letter), value.cast("bigint").cast("string"))
    parameter = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"))
    two = F.array(parameter(named("s", F.col("l_suppkey") % 5), named("T", F.col("l_partkey") % 4)), parameter(named("q", F.col("l_quantity") % 3), F.when(F.col("l_suppkey") % 3 > 0, "int")))
    none = F.lit(None).cast("string")
    tags = items.select(F.col("l_orderkey").alias("rel_fname"), F.row_number().over(by).cast("bigint").alias("line"), F.struct(two.alias("parameters"), none.alias("return_type"), none.alias("raw")).alias("signature"))
    fresh = views.with_fresh(tags, F.col("rel_fname"), F.col("line"))
    return fresh.select(F.col("rel_fname").alias("file"), "line", text.render_signature(F.col("signature"), F.lit(HIGH), F.col("fresh")).alias("shown"))


# --- diagnostics, directory view -----------------------------------------------------------------------------------


@query(
    f"""WITH {B.ORDER_HISTORY}, nw AS (SELECT max(ts) AS now FROM h), s AS (SELECT file, count(*) AS commits, max(ts) AS last FROM h GROUP BY file), a AS (SELECT file, commits, CAST(floor((epoch_us(now) - epoch_us(last)) / 86400000000) AS BIGINT) AS quiet FROM s, nw),
 w AS (SELECT file, CASE WHEN quiet <= 0 THEN 2.0 ELSE 1 + exp(-quiet / 30.0) END * CASE WHEN commits <= 5 THEN 1.0 ELSE least(1 + ln(1 + commits - 5) * 0.1, 1.5) END AS weight FROM a), t AS (SELECT * FROM w WHERE weight > 1 ORDER BY weight DESC, file LIMIT 5)
SELECT 'GIT:' || string_agg(file || ':' || printf('%.2f', weight), ',' ORDER BY weight DESC, file) AS line FROM t"""
)
def g16_git_part(spark, d):
    rows = B.order_history(spark, d)
    return export.git_part(history.file_weights(history.file_stats(rows), F.lit(rows.agg(F.max("ts")).first()[0])))


@query(
    f"""WITH {B.PART_RANKS}, {B.SYMBOL_EDGES}, b AS (SELECT 'Brand#' || (p_partkey % 25 + 1) AS name, 'NATION_' || (p_partkey % 20) AS f, rank FROM pr), m AS (SELECT name, max(rank * 1000 + CAST(substr(f, 8) AS INT)) AS k, max(rank) AS rank FROM b GROUP BY name),
 t AS (SELECT name, rank, (SELECT max(f) FROM b WHERE b.name = m.name AND b.rank = m.rank) AS f FROM m ORDER BY rank DESC, name LIMIT 10), x AS (SELECT t.name, t.rank, coalesce((SELECT sum(n) FROM sedges WHERE dst_file = t.f AND dst_sym = t.name), 0) AS refs FROM t)
SELECT 'TOP:' || string_agg(substr(name, 1, 12) || ':' || printf('%.3f', rank) || ':' || CAST(refs AS BIGINT) || '↓', ',' ORDER BY rank DESC, name) AS line FROM x"""
)
def g16_top_part(spark, d):
    key = F.col("p_partkey")
    ranked = B.part_ranks(spark, d).select(F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("name"), F.concat(F.lit("NATION_"), (key % 20).cast("string")).alias("rel_fname"), "rank")
    return export.top_part(ranked, graph.symbol_edges(B.symbol_tags(spark, d)))


@query(
    """WITH k AS (SELECT p_brand AS f, p_type AS name, CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'constant' END AS kind FROM part),
 g AS (SELECT f, list_sort(list(name) FILTER (kind = 'class')) AS cl, count(*) FILTER (kind = 'function') AS fn, count(*) FILTER (kind = 'method') AS mt, count(*) FILTER (kind = 'constant') AS co FROM k GROUP BY f),
 t AS (SELECT *, coalesce(len(cl), 0) AS n FROM g ORDER BY coalesce(len(cl), 0) * 3 + fn * 2 + mt + co DESC, f LIMIT 30)
SELECT f AS rel_fname, '  ' || f || ': ' || concat_ws('; ', CASE WHEN n > 0 THEN array_to_string(cl[1:3], ', ') || CASE WHEN n > 3 THEN ' +' || (n - 3) ELSE '' END END,
  nullif(concat_ws(' ', CASE WHEN fn > 0 THEN fn || 'f' END, CASE WHEN mt > 0 THEN mt || 'm' END, CASE WHEN co > 0 THEN co || 'c' END), '')) AS line FROM t"""
)
def o09_overflow(spark, d):
    kinds = F.array(*map(F.lit, ("class", "function", "method", "constant")))
    key = (F.col("p_partkey") % 4).cast("int")
    tags = table(spark, d, "part").select(F.col("p_brand").alias("rel_fname"), F.col("p_type").alias("name"), F.lit("def").alias("kind"), F.element_at(kinds, key + 1).alias("node_type"), F.when(key == 2, "Owner").alias("parent_name"))
    return views.overflow_lines(tags, 30)


@query("SELECT c_name AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j17_without_large_orders(spark, d):
    chat = table(spark, d, "orders").where("o_totalprice > 300000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("path"))
    return files.without_chat(table(spark, d, "customer").select(F.col("c_name").alias("path")), chat)


@query("SELECT count(*) AS files, CAST(sum(strlen(text) + strlen(doc_id || '.txt') + 164) AS BIGINT) AS bytes, sum(strlen(text) + strlen(doc_id || '.txt') + 164) > 204800 AS large FROM documents WHERE text IS NOT NULL")
def s17_concatenation_size(spark, d):
    return files.concatenation_size(table(spark, d, "documents", "doc_id", "text").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"))


@query(
    """WITH l AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN ' M cust/' || o_custkey WHEN 1 THEN 'R  old/' || o_orderkey || ' -> cust/' || o_custkey WHEN 2 THEN '?? new/' || o_orderkey ELSE '' END AS line FROM orders),
 r AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 3)
SELECT DISTINCT path FROM (SELECT CASE WHEN contains(line, ' -> ') THEN split_part(line, ' -> ', 2) ELSE substr(line, 4) END AS path FROM l WHERE length(line) > 3 UNION ALL SELECT o_custkey::VARCHAR FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM r))"""
)
def s13_signals(spark, d):
    key, customer = F.col("o_orderkey"), F.concat(F.lit("cust/"), F.col("o_custkey").cast("string"))
    line = F.when(key % 4 == 0, F.concat(F.lit(" M "), customer)).when(key % 4 == 1, F.concat(F.lit("R  old/"), key.cast("string"), F.lit(" -> "), customer)).when(key % 4 == 2, F.concat(F.lit("?? new/"), key.cast("string"))).otherwise("")
    status = files.status_paths(table(spark, d, "orders").select(line.alias("line")))
    return files.working_set(status, files.recent_paths(B.order_history(spark, d), 3, "1-URGENT"))

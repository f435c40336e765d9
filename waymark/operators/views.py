"""Views of ranked tags: relational preparation, and text of what a budget holds."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, HIGH, LOW, Config
from waymark.functions import paths, scoring, text
from waymark.operators.ordering import placed, top_per_group
from waymark.session import durable

CLASS, FUNCTION, METHOD, CONSTANT = "class", "function", "method", "constant"


def category(node_type: Column, parent: Column) -> Column:
    """What a definition is shown as; null for types that the directory view does not show."""
    return F.when(node_type == "class", CLASS).when((node_type == "method") | ((node_type == "function") & parent.isNotNull()), METHOD).when(node_type == "function", FUNCTION).when(node_type.isin("constant", "variable"), CONSTANT)


def category_counts(tags: DataFrame) -> DataFrame:
    """``rel_fname, classes, functions, methods, constants``."""
    kind = category(F.col("node_type"), F.col("parent_name"))
    count = lambda k, n: F.count_if(kind == k).alias(n)
    return tags.where("kind = 'def'").groupBy("rel_fname").agg(count(CLASS, "classes"), count(FUNCTION, "functions"), count(METHOD, "methods"), count(CONSTANT, "constants"))


def overflow(tags: DataFrame, shown: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Files of the overflow that are not shown, by ``3 classes + 2 functions + methods + constants``."""
    rest = tags.join(shown.select("rel_fname").distinct(), "rel_fname", "left_anti")
    # method nodes are left out here (Q23): only functions with a parent count as methods
    counts = category_counts(rest.where("node_type <> 'method'"))
    return counts.withColumn("score", 3 * F.col("classes") + 2 * F.col("functions") + F.col("methods") + F.col("constants")).orderBy(F.desc("score"), "rel_fname").limit(config.overflow_files)


def file_order(tags: DataFrame) -> DataFrame:
    """``rel_fname, max_rank``."""
    return tags.groupBy("rel_fname").agg(F.max("rank").alias("max_rank"))


def adaptive_detail(tags: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """``rel_fname, max_rank, detail`` by the file's place in the order of files."""
    rows = placed(file_order(tags), F.desc("max_rank"), F.col("rel_fname"))
    is_focus = F.col("rel_fname").isin(focus) if focus else F.lit(False)
    return rows.select("rel_fname", "max_rank", scoring.detail_bucket(F.col("place"), F.col("total"), is_focus).alias("detail"))


def first_types(patterns: DataFrame) -> DataFrame:
    """Of ``file, pattern, seq`` rows the first of each pattern in its file is spelled out."""
    return patterns.withColumn("first", F.row_number().over(Window.partitionBy("file", "pattern").orderBy("seq")) == 1)


def top_names(tags: DataFrame, n: int = 15) -> DataFrame:
    """The best row of each name, the ``n`` best names, cut to 12 characters."""
    best = tags.groupBy("name").agg(F.max("rank").alias("rank"))
    return best.orderBy(F.desc("rank"), "name").limit(n).select(F.substring("name", 1, 12).alias("name"), "rank")


def clusters(tags: DataFrame, path: str = "rel_fname", config: Config = DEFAULT) -> DataFrame:
    """``cluster, symbols, rank, top`` of the best clusters with two symbols or more."""
    rows = tags.withColumn("cluster", paths.cluster_key(F.col(path)))
    best = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("symbols"), F.sum("rank").alias("rank")).where("symbols >= 2").orderBy(F.desc("rank"), "cluster").limit(config.clusters)
    chosen = rows.join(F.broadcast(best.select("cluster")), "cluster")  # at most ``clusters`` rows
    top = top_per_group(chosen, ["cluster"], config.cluster_symbols, F.desc("rank"), F.col("name")).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("k"), "name"))), lambda x: x["name"]).alias("top"))
    return best.join(top, "cluster").orderBy(F.desc("rank"), "cluster")


def render_clusters(rows: list[Row]) -> str:
    out = ["# Repository Structure (confidence: low, showing clusters)", ""]
    for r in rows:
        out += [f"## {r['cluster']}/ ({r['symbols']} symbols, rank={r['rank']:.2f})", *(f"  - {n}" for n in r["top"])]
        if r["symbols"] > len(r["top"]):
            out.append(f"  ... +{r['symbols'] - len(r['top'])} more")
        out.append("")
    return "\n".join(out)


def render_flat(rows: list[Row]) -> str:
    """The best rows by themselves, a bounded number."""
    return "\n".join(["# Top Symbols (no clear clusters detected)", "", *(f"- {r['rel_fname']}:{r['name']}" for r in rows)])


def file_sizes(files: DataFrame, tags: DataFrame) -> DataFrame:
    """``path, loc, defs``."""
    defs = tags.where("kind = 'def'").groupBy("rel_fname").agg(F.count(F.lit(1)).alias("defs"))
    return files.join(defs, F.col("rel") == F.col("rel_fname"), "left").select(F.col("rel").alias("path"), text.lines_of_code(F.coalesce("text", F.lit(""))).cast("bigint").alias("loc"), F.coalesce("defs", F.lit(0)).alias("defs"))


def rollup(sizes: DataFrame) -> DataFrame:
    """``folder, files, loc, defs`` at every level, ``.`` for all."""
    rows = sizes.select(F.explode(paths.prefixes(F.col("path"))).alias("folder"), "loc", "defs")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("defs").alias("defs"))


def propagate_max(values: DataFrame, value: str = "rank") -> DataFrame:
    """``folder, value``: the largest below each folder."""
    return values.select(F.explode(paths.prefixes(F.col("path"))).alias("folder"), value).groupBy("folder").agg(F.max(value).alias(value))


def stats_lines(sizes: DataFrame, ranks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The flat listing, best files first, capped for display."""
    rows = sizes.join(ranks, F.col("path") == F.col("rel_fname"), "left").orderBy(F.desc_nulls_last("max_rank"), "path").limit(config.stats_files)
    return rows.select(F.format_string("%5d loc; %3d def  %s", "loc", "defs", "path").alias("line"))


def stats_tree(sizes: DataFrame) -> DataFrame:
    """The tree listing: folders before files, names without case, ``seq`` gives the order."""
    folder = rollup(sizes).where("folder <> '.'").select(F.col("folder").alias("path"), F.concat(text.basename(F.col("folder")), F.lit("/ "), F.format_string("%d files; %d loc; %d def", "files", "loc", "defs")).alias("shown"), F.lit(True).alias("is_folder"))
    files = sizes.select("path", F.concat(text.basename(F.col("path")), F.format_string(" %d loc; %d def", "loc", "defs")).alias("shown"), F.lit(False).alias("is_folder"))
    rows = folder.unionByName(files)
    parts, n = F.split("path", "/"), F.size(F.split("path", "/"))
    # each component sorts by (file, name): only the last one of a file is a file
    key = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when((i == n - 1) & ~F.col("is_folder"), "1").otherwise("0"), F.lower(p), F.lit("\u0001"))), "")
    return rows.select(key.alias("seq"), F.concat(F.repeat(F.lit("  "), n - 1), F.col("shown")).alias("line")).orderBy("seq")


def tree_lines(files: DataFrame, tags: DataFrame) -> DataFrame:
    """The source lines that tags point at, within the file, in order."""
    wanted = tags.select("rel_fname", "line").distinct()
    lines = files.join(wanted.select("rel_fname").distinct(), F.col("rel") == F.col("rel_fname"), "left_semi").select(F.col("rel").alias("rel_fname"), F.posexplode(F.split("text", "\n")).alias("at", "code"))
    shown = F.regexp_replace("code", r":\s*$", "")
    return lines.withColumn("line", F.col("at") + 1).join(wanted, ["rel_fname", "line"]).select("rel_fname", "line", shown.alias("code")).orderBy("rel_fname", "line")


def depths(tags: DataFrame) -> DataFrame:
    """``rel_fname, line, depth``: how many lines lie above a definition by ``parent_line``, 0 for none.

    A parent that is no definition counts and ends the climb; a line that climbs
    into a cycle counts every line that it meets, itself included, once.
    Pointers are doubled, so rounds grow with the logarithm of the depth.
    """
    rows = tags.where("kind = 'def'").groupBy("rel_fname", "line").agg(F.max(F.when(F.col("parent_line") > 0, F.col("parent_line"))).alias("above"))
    rows = durable(rows)
    up, reach, most = rows.withColumn("depth", F.when(F.col("above").isNull(), 0).otherwise(1).cast("bigint")), 1, rows.count()
    while reach <= most and not up.where("above is not null").isEmpty():
        further = up.select("rel_fname", F.col("line").alias("above"), F.col("above").alias("__further"), F.col("depth").alias("__more"))
        met = up.join(further, ["rel_fname", "above"], "left")
        up = durable(met.select("rel_fname", "line", F.col("__further").alias("above"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")))
        reach *= 2
    done, cyclic = up.where("above is null").select("rel_fname", "line", "depth"), up.where("above is not null")
    if cyclic.isEmpty():
        return done
    last = seen = cyclic.select("rel_fname", "line", F.col("line").alias("at"))
    above = rows.select("rel_fname", F.col("line").alias("at"), "above")
    while not last.isEmpty():
        reached = last.join(above, ["rel_fname", "at"]).select("rel_fname", "line", F.col("above").alias("at"))
        last = durable(reached.join(seen, ["rel_fname", "line", "at"], "left_anti"))
        seen = durable(seen.unionByName(last))
    return done.unionByName(seen.groupBy("rel_fname", "line").agg(F.count(F.lit(1)).alias("depth")))


def methods_of(tags: DataFrame) -> DataFrame:
    """``rel_fname, class, methods`` by the name of the parent."""
    classes = tags.where("kind = 'def' and node_type = 'class'").select("rel_fname", F.col("name").alias("class")).distinct()
    kind = category(F.col("node_type"), F.col("parent_name"))
    found = tags.where((F.col("kind") == "def") & (kind == METHOD)).select("rel_fname", F.col("parent_name").alias("class"), F.col("name").alias("method")).distinct()
    return classes.join(found, ["rel_fname", "class"]).groupBy("rel_fname", "class").agg(F.sort_array(F.collect_list("method")).alias("methods"))


def annotate(tags: DataFrame, *, bridges: DataFrame | None = None, api: DataFrame | None = None, phases: DataFrame | None = None, badges: DataFrame | None = None, mates: DataFrame | None = None) -> DataFrame:
    """Marks of files (``bridge``, ``phase``, ``badges``, ``mates``) and symbols (``api``) on tags."""
    out = tags
    if bridges is not None:
        out = out.join(bridges.select(F.col("id").alias("__b")).distinct(), F.col("rel_fname") == F.col("__b"), "left").withColumn("bridge", F.col("__b").isNotNull()).drop("__b")
    if api is not None:
        mark = api.where("label = 'api'").select(F.col("file").alias("__f"), F.col("symbol").alias("__s")).distinct()
        out = out.join(mark, (F.col("rel_fname") == F.col("__f")) & (F.col("name") == F.col("__s")), "left").withColumn("api", F.col("__f").isNotNull()).drop("__f", "__s")
    for frame, column in ((phases, "phase"), (badges, "badges"), (mates, "mates")):
        if frame is not None:
            out = out.join(frame.select(F.col("file").alias("__f"), column), F.col("rel_fname") == F.col("__f"), "left").drop("__f")
    return out


def with_fresh(tags: DataFrame, *order: Column, within: str | None = "rel_fname") -> DataFrame:
    """Adds ``fresh``: of which parameters the pair of name and type has not been shown before, in that order.

    ``within`` names the column that starts anew (a file by default, null: all
    rows at once).  What comes first is a minimum over the pair, so no file's
    rows have to be folded one by one.  The order has to be total.
    """
    rows = placed(tags, *order).drop("total").withColumnRenamed("place", "__row")
    scope = F.lit(None).cast("string") if within is None else F.col(within)
    parameters = rows.select("__row", scope.alias("__scope"), F.posexplode("signature.parameters").alias("__at", "__p"))
    parameters = parameters.select("__row", "__scope", "__at", F.struct("__p.name", "__p.type").alias("__pair"), F.struct("__row", "__at").alias("__place"))
    first = parameters.groupBy("__scope", "__pair").agg(F.min("__place").alias("__place"))
    # the places that come first, by row; a signature bounds their number
    new = first.groupBy(F.col("__place.__row").alias("__r")).agg(F.collect_set("__place.__at").alias("__new"))
    marked = rows.join(new, F.col("__row") == F.col("__r"), "left")
    fresh = F.transform(F.col("signature.parameters"), lambda _, i: F.coalesce(F.array_contains("__new", i), F.lit(False)))
    return marked.withColumn("fresh", fresh).drop("__row", "__r", "__new")


def rendered(tags: DataFrame, detail: Column) -> DataFrame:
    """Tags with ``shown``: name and signature (X36) or class preview (X38) in a detail level; with a column ``fresh`` repeated types are left out."""
    name, signature = F.col("name"), F.col("signature")
    function = F.concat(name, F.coalesce(text.render_signature(signature, detail, F.col("fresh") if "fresh" in tags.columns else None), F.lit("")))
    return tags.withColumn("shown", F.when(F.col("node_type") == "class", text.class_preview(name, F.col("fields"), detail)).when(signature.isNotNull(), function).otherwise(name))


def file_head(row: Row) -> list[str]:
    """A file's line with its marks, and what it changes with, from the columns of ``annotate`` that a row has."""
    has = lambda name: row[name] if name in row else None
    marks = ["bridge"] if has("bridge") else []
    marks += [has("phase")] if has("phase") else []
    out = [f"{row['rel_fname']}:" + "".join(f" [{m}]" for m in [*marks, *(has("badges") or [])])]
    if has("mates"):
        out.append("  ⇄ changes with: " + ", ".join(f"{m['mate']}({m['score']:.0%})" for m in has("mates")))
    return out


def overflow_lines(rows: DataFrame, files: int) -> DataFrame:
    """``rel_fname, line``: the names of classes and counts of the rest in files beyond the detailed view, fullest first."""
    kind = category(F.col("node_type"), F.col("parent_name"))
    of = lambda k: F.count_if(kind == k)
    found = rows.where("kind = 'def'").groupBy("rel_fname").agg(F.sort_array(F.collect_list(F.when(kind == CLASS, F.col("name")))).alias("classes"), of(FUNCTION).alias("f"), of(METHOD).alias("m"), of(CONSTANT).alias("c"))
    n = F.size("classes")
    more = F.when(n > 3, F.concat(F.lit(" +"), (n - 3).cast("string"))).otherwise("")
    counts = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(k))) for k in ("f", "m", "c")))), " ")
    parts = F.array_compact(F.array(F.when(n > 0, F.concat(F.array_join(F.slice("classes", 1, 3), ", "), more)), F.when(counts != "", counts)))
    # classes weigh most, then functions
    best = found.where((n > 0) | (counts != "")).orderBy(F.desc(n * 3 + F.col("f") * 2 + F.col("m") + F.col("c")), "rel_fname").limit(files)
    return best.select("rel_fname", F.concat(F.lit("  "), F.col("rel_fname"), F.lit(": "), F.array_join(parts, "; ")).alias("line"))


def render_directory(rows: list[Row], detail: int, width: int = 100) -> str:
    """Files by their best row, with their marks; classes with methods, functions and constants, wrapped.

    ``rows`` are collected ranked tags with ``shown_1`` to ``shown_3``; a budget
    bounds their number.
    """
    best: dict[str, float] = {}
    for r in rows:
        best[r["rel_fname"]] = max(best.get(r["rel_fname"], 0.0), r["rank"])
    out: list[str] = []

    def listed(label: str, items: list[str], indent: str) -> None:
        line, pad = f"{indent}{label}: ", indent + " " * (len(label) + 2)
        for i, item in enumerate(items):
            add = ("" if i == 0 else ", ") + item
            if len(line) + len(add) > width and line.strip() and i:
                out.append(line + ",")
                line, add = pad, item
            line += add
        out.append(line)

    kinds = {"class": CLASS, "method": METHOD, "constant": CONSTANT, "variable": CONSTANT}
    for file, group in groupby(sorted((r for r in rows if r["kind"] == "def"), key=lambda r: (-best[r["rel_fname"]], r["rel_fname"])), key=lambda r: r["rel_fname"]):
        group = list(group)
        out += file_head(group[0])
        parts: dict[str, list[Row]] = {CLASS: [], FUNCTION: [], METHOD: [], CONSTANT: []}
        for r in group:
            kind = kinds.get(r["node_type"]) or (FUNCTION if r["node_type"] == "function" else None)
            if kind == FUNCTION and r["parent_name"]:
                kind = METHOD
            if kind:
                parts[kind].append(r)
        shown = lambda r: r[f"shown_{detail}"]
        for c in parts[CLASS]:
            inner = [m for m in parts[METHOD] if m["parent_name"] == c["name"]]
            out.append(f"  class {shown(c)}" + (":" if inner else ""))
            props = [m for m in inner if m["signature"] and "property" in (m["signature"]["decorators"] or ())]
            for label, items in (("props", props), ("def", [m for m in inner if m not in props])):
                if items:
                    listed(label, [shown(m) for m in items], "    ")
        for label, kind in (("def", FUNCTION), ("const", CONSTANT)):
            if parts[kind]:
                listed(label, [shown(r) for r in parts[kind]], "  ")
    return "\n".join(out)


def header_line(level: str, patterns: list[str], tokens: int, budget: int, tags: int) -> str:
    """Nothing below five tags."""
    if tags < 5:
        return ""
    note = ", ".join(patterns[:2]) or ("clear hierarchy" if level == "high" else "normal")
    return f"# confidence: {level} ({note}) | {tokens / 1000:.1f}k/{budget / 1000:.1f}k tokens"


DETAILS = (LOW, 2, HIGH)

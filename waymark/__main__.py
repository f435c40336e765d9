"""Command line: ``python -m waymark [PATHS...]`` prints a map, statistics, a search or the joined text of a file tree."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from waymark.config import DEFAULT
from waymark.functions import paths as path_functions
from waymark.operators import context, extract
from waymark.plans.engine import Engine
from waymark.session import session, workers_find_package
from waymark.sources import cache, files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="waymark", description="Ranked maps of source trees")
    out.add_argument("paths", nargs="*", help="files or folders below the root that the map is about (all)")
    out.add_argument("--root", default=".", help="the tree")
    out.add_argument("--map-tokens", type=int, default=DEFAULT.map_tokens)
    out.add_argument("--max-context-window", type=int)
    out.add_argument("--focus", "-f", nargs="*", default=[], help="files, or queries on names")
    out.add_argument("--mentioned-files", nargs="*", default=[])
    out.add_argument("--mentioned-idents", nargs="*", default=[])
    out.add_argument("--ext", default="", help="suffixes to keep, as py,js")
    out.add_argument("--exclude-unranked", action="store_true")
    out.add_argument("--no-symbol-rank", action="store_true")
    out.add_argument("--adaptive", action="store_true", help="clusters where confidence is low")
    out.add_argument("--marks", action="store_true", help="bridges, phases, badges and change mates")
    out.add_argument("--iterations", type=int, help="rounds of PageRank (until ranks settle)")
    out.add_argument("--cache", help="a folder for the tags of unchanged files")
    out.add_argument("--force-refresh", action="store_true")
    mode = out.add_mutually_exclusive_group()
    mode.add_argument("--stats", action="store_true", help="lines and definitions of each file")
    mode.add_argument("--tree", action="store_true", help="with totals of folders")
    mode.add_argument("--search", metavar="TEXT", help="names that hold the text")
    mode.add_argument("--join", action="store_true", help="the files' texts, one after another")
    mode.add_argument("--report", action="store_true", help="how many definitions, references and files")
    return out


def main(arguments: list[str] | None = None, spark=None) -> int:
    asked = parser().parse_args(arguments)
    spark = spark or session()
    workers_find_package(spark)
    root = os.path.abspath(asked.root)
    found = files.walked(files.tree(spark, root), root)
    if asked.paths:
        wanted = [os.path.relpath(os.path.join(root, p), root) for p in asked.paths]
        below = path_functions.relative(F.col("path"), root)
        met = [(below == w) | below.startswith(w.rstrip("/") + "/") if w != "." else F.lit(True) for w in wanted]
        found = found.where(F.coalesce(*[F.when(m, True) for m in met], F.lit(False)))
    texts = files.with_text(files.with_extensions(found, asked.ext), root)
    tags = None
    if asked.cache:
        tags = cache.cached_tags(spark, texts, extract.tags, asked.cache, asked.force_refresh)
    engine = Engine(files=texts, tags=tags, symbol_rank=not asked.no_symbol_rank, exclude_unranked=asked.exclude_unranked, marks=asked.marks, max_context_window=asked.max_context_window, iterations=asked.iterations)
    if asked.join:
        blocks = files.concatenated(texts.select(F.col("rel").alias("path"), "text"))
        if files.concatenation_size(texts).first()["large"]:
            print(f"more than {files.LARGE} bytes", file=sys.stderr)
        for row in blocks.toLocalIterator():
            print(row["block"], end="")
    elif asked.stats or asked.tree:
        print("\n".join(engine.stats(tree=asked.tree)))
    elif asked.search:
        for row in context.search(engine.all_tags(), asked.search).collect():
            print(f"{row['rel_fname']}:{row['line']}: {row['kind']} {row['name']}")
    elif asked.report:
        print(engine.report().first().asDict())
    else:
        shown = engine.map(asked.focus, budget=asked.map_tokens, adaptive=asked.adaptive, mentioned_files=asked.mentioned_files, mentioned_idents=asked.mentioned_idents)
        if not shown:
            print("nothing to show", file=sys.stderr)
            return 1
        print(shown)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from waymark.queries import QUERIES
from waymark.session import session

HEADLINE = ("j01_file_edges", "g01_file_pagerank", "j02_symbol_edges", "g08_surface", "g09_coupling", "g10_git_weights", "x14_phases", "g12_confidence", "w02_adaptive_detail", "w07_budget_prefix", "a21_rollup", "a22_clusters", "g11_stories", "a19_lines_of_code", "f09_search")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", partitions=int(cpus), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

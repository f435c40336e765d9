"""The segmented scan: heads at every partition edge, long and short segments, nulls."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.scan import carried
from waymark.sources import history


def brute(rows):
    out, last = [], {}
    for log, seq, line in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if line is not None and line.startswith("H"):
            last[log] = line
        out.append((log, seq, line, last.get(log)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [1, 2, 7, 1000])
@pytest.mark.parametrize("partitions", ["1", "16"])
def test_carried(spark, every, partitions):
    rnd = random.Random(every)
    rows = [("long", i, f"H{i}" if i % every == every - 1 else rnd.choice([None, "x"])) for i in range(900)]
    rows += [(f"l{k}", i, "H" if rnd.random() < 0.2 else "y") for k in range(12) for i in range(5)] + [(None, i, "H0" if i == 3 else "z") for i in range(6)]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "log string, seq long, line string")
        got = carried(df, "log", "seq", F.when(F.col("line").startswith("H"), F.col("line")), "head").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.log, r.seq, r.line, r.head) for r in got), key=repr) == brute(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "log string, seq long, line string")
    assert carried(none, "log", "seq", F.col("line"), "head").count() == 0
    assert history.parse_stats_log(none).count() == 0


def test_story_log_of_a_commit_with_many_lines_and_one_that_comes_twice(spark):
    one, two = "a" * 40, "b" * 40
    lines = ["lost", one, "Ann", "2024-01-02T03:04:05", "first", *("more" for _ in range(300)), "", two, "Bob", "2024-01-03T03:04:05", one, "Cy", "2024-01-04T03:04:05", "again"]
    df = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], "symbol string, seq long, line string")
    got = sorted((r.commit_id[0], r.author, r.subject) for r in history.parse_story_log(df).collect())
    assert got == [("a", "Ann", "first"), ("a", "Cy", "again")]

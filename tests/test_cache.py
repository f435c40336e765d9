"""The extraction cache: upserts, writers at the same time, jobs that fail, tasks that are retried."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waymark.operators import extract
from waymark.sources import cache

NOW = datetime(2024, 1, 1)


def listed(spark, texts, day=1):
    return spark.createDataFrame([(p, p, NOW.replace(day=day), t) for p, t in texts.items()], "path string, rel string, modified timestamp, text string")


def names(df):
    return sorted(r.name for r in df.collect())


def rows(spark, place):
    return spark.read.parquet(f"{place}/v{cache.VERSION}").count()


def test_upsert(spark, tmp_path):
    place, seen = str(tmp_path), []

    def extracted(files):
        seen.extend([sorted(r.path for r in files.collect())] if not files.isEmpty() else [])
        return extract.tags(files)

    first = listed(spark, {f"f{i}.py": f"def a{i}(): pass" for i in range(6)} | {"none.py": "", "odd.txt": "x"})
    assert names(cache.cached_tags(spark, first, extracted, place)) == [f"a{i}" for i in range(6)]
    assert names(cache.cached_tags(spark, first, extracted, place)) == [f"a{i}" for i in range(6)]
    assert len(seen) == 1 and rows(spark, place) == 8
    changed = first.where("path <> 'f2.py'").unionByName(listed(spark, {"f2.py": "def b(): pass\ndef c(): pass"}, 2))
    assert names(cache.cached_tags(spark, changed, extracted, place)) == ["a0", "a1", "a3", "a4", "a5", "b", "c"]
    # the old version has made room
    assert seen[1:] == [["f2.py"]] and rows(spark, place) == 9
    assert names(cache.cached_tags(spark, changed, extracted, place, refresh=True)) == ["a0", "a1", "a3", "a4", "a5", "b", "c"]
    assert len(seen[2]) == 8 and rows(spark, place) == 9
    assert cache.cached_tags(spark, first.where("false"), extracted, place).count() == 0


def test_two_writers(spark, tmp_path):
    files = listed(spark, {f"f{i}.py": f"def a{i}(): pass" for i in range(40)})
    halves = [files.where("length(path) < 6"), files]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda part: cache.cached_tags(spark, part, extract.tags, str(tmp_path)).count(), halves))
    table = spark.read.parquet(f"{tmp_path}/v{cache.VERSION}")
    assert table.groupBy("path").count().where("count > 1").count() == 0
    assert names(cache.cached_tags(spark, files, extract.tags, str(tmp_path))) == sorted(f"a{i}" for i in range(40))
    assert rows(spark, tmp_path) == 40


def test_a_job_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    files = listed(spark, {"f.py": "def a(): pass"})
    cache.cached_tags(spark, files, extract.tags, str(tmp_path)).collect()
    broken = lambda df: extract.tags(df).withColumn("name", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception):
        cache.cached_tags(spark, listed(spark, {"f.py": "def b(): pass"}, 3), broken, str(tmp_path)).collect()
    assert names(cache.cached_tags(spark, files, extract.tags, str(tmp_path))) == ["a"] and rows(spark, tmp_path) == 1
    # the job is run again, and once more
    for _ in range(2):
        assert names(cache.cached_tags(spark, listed(spark, {"f.py": "def b(): pass"}, 3), extract.tags, str(tmp_path))) == ["b"]
    assert rows(spark, tmp_path) == 1

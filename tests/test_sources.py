"""Files, logs, cache and streams."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from waymark import streaming
from waymark.operators import extract
from waymark.sources import cache, files, history


def write(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return str(path)


def test_tree(spark, tmp_path):
    write(tmp_path, "a.py", b"x = 1\n")
    write(tmp_path, "sub/b.py", b"bad \xff byte")
    write(tmp_path, "README.md", b"# T")
    write(tmp_path, "node_modules/c.js", b"//")
    write(tmp_path, ".hidden/d.py", b"")
    tree = files.tree(spark, str(tmp_path))
    rel = lambda df: sorted(os.path.relpath(r.path, tmp_path) for r in df.collect())
    assert rel(files.walked(tree, str(tmp_path))) == ["a.py", "sub/b.py"]
    assert rel(files.with_extensions(tree, "py,js")) == ["a.py", "node_modules/c.js", "sub/b.py"]
    listing = spark.createDataFrame([(str(tmp_path / "a.py"),), (str(tmp_path / "README.md"),), ("/gone.py",)], "path string")
    assert rel(files.listed(tree, listing)) == ["a.py"]
    found, lost = files.tracked(listing, tree)
    assert found.count() == 2 and [r.reason for r in lost.collect()] == ["[EXCLUDED] File not found"]
    texts = {r.rel: r.text for r in files.with_text(tree, str(tmp_path)).collect()}
    assert texts["sub/b.py"] == "bad  byte"
    joined = files.concatenated(files.with_text(tree)).collect()
    assert len(joined) == 4 and joined == sorted(joined, key=lambda r: r.path) and "=" * 80 in joined[0].block
    assert files.working_set(listing, listing).count() == 3


def test_source_dirs():
    assert files.source_dirs('[tool.setuptools]\npackages = ["pkg", "pkg.sub"]\npy-modules = ["main"]') == ["pkg", "main.py"]
    assert files.source_dirs("not toml [") == [] and files.source_dirs("") == []


def test_logs(spark):
    lines = lambda rows: spark.createDataFrame([("l", i, x) for i, x in enumerate(rows)], "log string, seq int, line string")
    commit = "a" * 40
    assert [(r.commit_id, r.file) for r in history.parse_touch_log(lines([commit, "", "x.py", "y.py"])).collect()] == [(commit, "x.py"), (commit, "y.py")]
    story = history.parse_story_log(lines([commit, "Ann", "2024-01-02T03:04:05Z", "subject"]).withColumnRenamed("log", "symbol")).first()
    assert (story.author, story.subject) == ("Ann", "subject")
    assert history.parse_stats_log(lines(["orphan line"])).count() == 0


def test_cache(spark, tmp_path):
    calls = []

    def take(df):
        calls.append(df.count())
        return extract.tags(df)

    def run(code, at, **options):
        rows = spark.createDataFrame([("/r/a.py", "a.py", code, at), ("/r/b.py", "b.py", "def b(): pass\n", datetime(2024, 1, 1))], "path string, rel string, text string, modified timestamp")
        return sorted(r.name for r in cache.cached_tags(spark, rows, take, str(tmp_path), **options).collect())

    assert run("def old_function(): pass\n", datetime(2024, 1, 1)) == ["b", "old_function"]
    assert run("def old_function(): pass\n", datetime(2024, 1, 1)) == ["b", "old_function"]
    assert run("def new_function(): pass\n", datetime(2024, 1, 2)) == ["b", "new_function"]
    assert calls == [2, 0, 1]


def test_streams(spark, tmp_path):
    rows = [("f", "a", datetime(2024, 1, 1, 0, i)) for i in range(4)] + [("f", "b", datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "file string, author string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, author string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("activity", streaming.windowed_activity(stream)), ("bursts", streaming.sessions(stream)), ("stats", streaming.running_stats(stream))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert [r.commits for r in spark.table("activity").orderBy("window").collect()] == [4, 1]
    assert sorted(r.changes for r in spark.table("bursts").collect()) == [1, 4]
    assert spark.table("stats").select(F.sum("commits")).first()[0] == 5

"""The set-similarity join against all pairs, and on an element that every set has."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import history, similarity


def brute(sets, threshold):
    out = {}
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                out[a, b] = (both, round(both / len(sets[a] | sets[b]), 9))
    return out


@pytest.mark.parametrize("threshold", [0.05, 1 / 3, 0.5, 0.8, 1.0])
def test_against_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    sets = {}
    for i in range(60):
        base = set(rnd.sample(range(40), rnd.randrange(1, 9)))
        sets[f"s{i:02}"] = base
        if rnd.random() < 0.5:
            sets[f"t{i:02}"] = {e for e in base if rnd.random() < 0.9} | set(rnd.sample(range(40), rnd.randrange(2)))
    rows = [(s, str(e)) for s, found in sets.items() for e in found]
    rows += rows[:30] + [(None, "1"), ("s00", None)]
    got = similarity.similar_sets(spark.createDataFrame(rows, "set string, element string"), threshold).collect()
    assert {(r.a, r.b): (r.together, round(r.score, 9)) for r in got} == brute(sets, threshold)
    assert len(got) == len({(r.a, r.b) for r in got})


def test_empty_and_bad_thresholds(spark):
    none = spark.createDataFrame([], "set string, element string")
    assert similarity.similar_sets(none, 0.5).count() == 0
    for threshold in (0, 1.5):
        with pytest.raises(ValueError):
            similarity.similar_sets(none, threshold)


def test_a_commit_that_touches_every_file(spark):
    """20,000 files in one commit, and two copies of each in commits of their own: 20,000 candidates, not 200 million."""
    n = 20_000
    files = spark.range(n)
    name = F.concat(F.lit("f"), F.col("id").cast("string"))
    own = files.select(name.alias("file"), F.explode(F.sequence(F.col("id") * 9, F.col("id") * 9 + 8)).alias("commit_id"))
    twin = files.where("id % 2 = 0").select(F.concat(name, F.lit("x")).alias("file"), F.explode(F.sequence(F.col("id") * 9, F.col("id") * 9 + 7)).alias("commit_id"))
    touches = own.unionByName(twin)
    touches = touches.unionByName(touches.select("file").distinct().withColumn("commit_id", F.lit(-1).cast("bigint")))
    sets = touches.select(F.col("file").alias("set"), F.col("commit_id").alias("element"))
    assert similarity.candidates(similarity.prefixes(sets, 0.5), 0.5).count() == n // 2
    # told by itself: the pairs of the wide commit are thousands of times the touches
    found = history.coupling(touches, threshold=0.5)
    assert found.count() == n // 2 and {round(r.score, 9) for r in found.select("score").distinct().collect()} == {0.9}

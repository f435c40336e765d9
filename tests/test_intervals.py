"""Binned interval joins and nearest scopes against brute force, over partition edges."""

import random

import pytest

from waymark.operators import intervals


def some(rnd, groups, n):
    out = []
    for _ in range(n):
        start = rnd.randrange(200)
        out.append((rnd.choice(groups), start, rnd.choice([None, start, start + rnd.randrange(4), start + rnd.randrange(300), start - 1])))
    return out


def test_within_and_outside(spark):
    rnd = random.Random(2)
    spans = [(*s, i) for i, s in enumerate(some(rnd, ["a", "b", None], 60))] + [("a", None, 5, 99)]
    points = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-3, 260)]), i) for i in range(150)]
    left = spark.createDataFrame(points, "group string, at long, p int")
    right = spark.createDataFrame(spans, "group string, start long, end long, s int")
    want = {(p, s) for g, at, p in points for h, start, end, s in spans if g == h and g and at is not None and start is not None and start <= at and (end is None or at <= end)}
    got = [(r.p, r.s) for r in intervals.within(left, right).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted(r.p for r in intervals.outside(left, right).collect()) == sorted({p for _, _, p in points} - {p for p, _ in want})
    assert intervals.within(left, right.where("false")).count() == 0 and intervals.outside(left, right.where("false")).count() == len(points)


def nested(rnd, group, low, high, out, depth=0):
    """Properly nested intervals."""
    while low < high and rnd.random() < 0.9:
        start = rnd.randrange(low, high)
        end = rnd.randrange(start, high)
        out.append((group, start, end))
        if depth < 6:
            nested(rnd, group, start, end, out, depth + 1)
        low = end + 1


@pytest.mark.parametrize("partitions", ["1", "12"])
def test_nearest(spark, partitions):
    rnd = random.Random(9)
    rows = [("deep", i, 5000 - i) for i in range(300)] + [("open", 3, None), ("open", 5, 5), ("open", 9, None)]
    for group in ("a", "b"):
        nested(rnd, group, 0, 2000, rows)
    rows += [("same", 4, 8), ("same", 4, 8), ("same", 4, 6)]
    spans = [(*r, i) for i, r in enumerate(rows)]
    limit = 1 << 62
    holders = {i: [(s, -(e or limit), j) for g, s, e, j in spans if g == group and j != i and s <= start and (e or limit) >= (end or limit) and ((s, e, j) < (start, end, i) if (s, e) == (start, end) else True)] for group, start, end, i in spans}
    want = {i: (max(h)[2] if h else None, len(h)) for i, h in holders.items()}
    rnd.shuffle(spans)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(spans, "group string, start long, end long, id long")
        got = {r.id: (r.parent, r.depth) for r in intervals.nearest(df).collect()}
        points = [(g, at) for g in ("a", "deep", "none") for at in (0, 7, 250, 299, 4701, 6000)] + [("open", 10), ("open", 5), ("a", None)]
        owners = {(r.group, r.at): r.owner for r in intervals.enclosing(spark.createDataFrame(points, "group string, at long"), df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and max(d for _, d in got.values()) > 100
    for (group, at), owner in owners.items():
        inside = [(s, -(e or limit), i) for g, s, e, i in spans if g == group and at is not None and s <= at <= (e or limit)]
        assert owner == (max(inside)[2] if inside else None), (group, at)
    assert len(owners) == len(points)

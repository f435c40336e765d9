"""Passages of long items and copies with words put in or left out."""

import random
import re

import pytest

from waymark.llm import decontamination


@pytest.mark.parametrize("inline", [100_000, 0])
def test_passages(spark, docs, inline):
    long, short = [f"long{i}" for i in range(200)], [f"short{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    other = " ".join(f"other{i}" for i in range(60))
    put_in = long[:12] + ["new"] + long[12:24]
    frame = docs(
        (1, f"{other} {' '.join(long[50:140])} {other}"), (2, f"{other} {' '.join(put_in)}"), (3, " ".join(long[:10] + long[11:21])), (4, " ".join(short[:9] + ["new"] + short[9:18])),
        (5, f"{' '.join(long[:8])} {other} {' '.join(long[100:108])}"), (6, other), (7, " ".join(short[:8])), (8, " ".join(long)), (9, " ".join(long[:15])),
    )
    got = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(frame, bench, inline=inline).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (8, 1)}
    assert (got[1, 1].n_matched, got[1, 1].start, got[1, 1].length, got[1, 1].n_item) == (90, 60, 90, 200)
    assert (got[2, 1].n_matched, got[2, 1].length) == (24, 25) and got[8, 1].n_matched == 200


def test_each_single_substitution(spark, docs):
    """An item of eight tokens is found with any one of them replaced, and with punctuation before it."""
    words = [f"w{i}" for i in range(8)]
    rows = [(at, "... " + " ".join(["zz" if i == at else w for i, w in enumerate(words)]) + " and more") for at in range(8)] + [(8, "-- " + " ".join(words))]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:7]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.overlaps(docs(*rows), bench).collect()}
    assert sorted(got) == list(range(9)) and {r.item_id for r in got.values()} == {1}
    assert all(got[at].n_matched == 7 for at in range(8)) and (got[8].start, got[8].n_matched) == (0, 8) and got[0].start == 1


def test_recall_of_substitutions(spark, docs):
    """Items of the benchmark table in foreign prose with a share of their tokens replaced."""
    rnd = random.Random(6)
    items = [(r.item_id, decontamination_words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    items = [(i, w) for i, w in items if len(w) >= 8]
    rows = []
    for share, at in ((0.05, 0), (0.1, 1), (0.15, 2), (0.2, 3)):
        for i, w in items:
            text = [f"x{rnd.randrange(10**6)}" if rnd.random() < share else t for t in w]
            prose = [f"p{rnd.randrange(10**6)}" for _ in range(60)]
            rows.append((at * 10**6 + i, " ".join(prose[:30] + text + prose[30:])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id // 10**6, r.doc_id % 10**6) for r in decontamination.overlaps(docs(*rows), bench).collect() if r.doc_id % 10**6 == r.item_id}
    recall = [sum(a == at for a, _ in got) / len(items) for at in range(4)]
    assert recall[0] >= 0.97 and recall[1] >= 0.95 and recall[2] >= 0.9, recall
    print("recall at 5, 10, 15, 20 % replaced:", recall, "items", len(items))


def decontamination_words(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]

"""Packing around a guess: the same choice as the plain search, and guesses that are near."""

import random

from pyspark.sql import functions as F

from tests.test_operators import modules, sources
from waymark.config import HIGH, LOW, MEDIUM
from waymark.operators import context, packing, views
from waymark.plans.engine import Engine


def test_same_choice_for_any_guess():
    rnd = random.Random(6)
    for _ in range(300):
        sizes = {d: [rnd.randrange(1, 9) * d for _ in range(rnd.randrange(1, 60))] for d in (LOW, MEDIUM, HIGH)}
        n = min(map(len, sizes.values()))
        head, budget = list(range(n)), rnd.randrange(1, 300)
        calls = []

        def render(rows, detail):
            calls.append(len(rows))
            return "x" * sum(sizes[detail][: len(rows)])

        run = lambda **o: packing.pack(head, budget, render, len, **o)  # noqa: B023, E731
        try:
            want = run()
        except ValueError:
            want = None
        for guess in ({LOW: 1, MEDIUM: n, HIGH: rnd.randrange(-3, n + 9)}, {d: rnd.randrange(1, n + 1) for d in (LOW, MEDIUM, HIGH)}, {}):
            try:
                assert run(guess=guess) == want
            except ValueError:
                assert want is None


def test_guesses_are_near_and_few_prefixes_are_rendered(spark):
    engine = Engine(files=sources(spark, *modules(12)), iterations=3)
    rows = views.with_fresh(engine.ranked(), F.col("rel_fname"), F.col("parent_name").isNull(), *context.by_rank())
    for detail in (LOW, MEDIUM, HIGH):
        rows = views.rendered(rows, F.lit(detail)).withColumnRenamed("shown", f"shown_{detail}")
    sized = packing.sizes(rows, *context.by_rank()).orderBy("place").collect()
    assert [r.place for r in sized] == list(range(len(sized)))
    for detail in (LOW, MEDIUM, HIGH):
        whole = len(views.render_directory(sized, detail))
        assert abs(sized[-1][f"size_{detail}"] - whole) < 0.25 * whole
    count = lambda s: -(-len(s) // 4)
    for budget in (30, 80, 200, 5000):
        guess = {d: sum(r[f"size_{d}"] <= 4 * budget for r in sized) for d in (LOW, MEDIUM, HIGH)}
        assert packing.pack(sized, budget, views.render_directory, count, guess=guess) == packing.pack(sized, budget, views.render_directory, count)

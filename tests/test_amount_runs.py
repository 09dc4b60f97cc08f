import random

from pyspark.sql import functions as F

from payscope.operators.rules.lists import BASE, _amount_runs


def test_runs_tile_the_interval(spark):
    """Every whole number of an interval lies in exactly one run, and a level has at most two."""
    rng = random.Random(3)
    wanted = [(a, a + rng.choice([0, 1, 6, 7, 8, 9, 63, 64, 65, 700, 5000])) for a in (rng.randrange(-3000, 9000) for _ in range(120))]
    wanted += [(0, 0), (7, 8), (8, 15), (-1, 0), (5, 4), (-10 ** 18 + 1, 10 ** 18 - 1)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(wanted)], "i int, a long, b long")
    runs: dict = {}
    for r in _amount_runs(rows, F.col("a"), F.col("b")).collect():
        assert 0 <= r["first"] < r["behind"] <= BASE
        width = BASE ** r["level"]
        start = r["parent"] * BASE * width
        runs.setdefault(r["i"], []).append((start + r["first"] * width, start + r["behind"] * width, r["level"]))
    for i, (a, b) in enumerate(wanted):
        got = sorted(runs.get(i, []))
        assert all(x[1] == y[0] for x, y in zip(got, got[1:]))
        assert (got[0][0], got[-1][1]) == (a, b + 1) if a <= b else not got
        levels = [x[2] for x in got]
        assert all(levels.count(n) <= 2 for n in levels)

"""Blocked scans against plain Python on small random histories with ties, hot keys and times before the epoch."""
import random

import pytest
from pyspark.sql import functions as F

from payscope.operators.timeline import Measure, coverage, range_max, recent, scan
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def history():
    rng = random.Random(3)
    return [(rng.choice(["a", "a", "b"]), rng.randrange(-40, 60), rng.randrange(0, 9), i, rng.random() < 0.8) for i in range(160)]


def frame(spark, history):
    return spark.createDataFrame(history, "k string, t long, v long, id long, real boolean")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scan(spark, history, block):
    rows = frame(spark, history).select("k", "t", "real", F.col("v").alias("s"), F.col("v").alias("r"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    got = scan(rows, ["k"], "t", [Measure("s", here=True), Measure("r", range_ms=10), Measure("lo", "min"), Measure("hi", "max")], block_ms=block)
    want = {}
    for k, t in {(h[0], h[1]) for h in history if any(x[4] and x[:2] == h[:2] for x in history)}:
        mine = [h for h in history if h[0] == k]
        prior = [h[2] for h in mine if h[1] < t]
        want[(min(prior, default=None), max(prior, default=None), k, sum(h[2] for h in mine if t - 10 <= h[1] <= t),
              sum(h[2] for h in mine if h[1] <= t), sum(h[2] for h in mine if h[1] == t), t)] = 1
    assert rows_of(got.select(F.col("lo").alias("a1"), F.col("hi").alias("a2"), F.col("k").alias("a3"), F.col("r").alias("a4"),
                              F.col("s").alias("a5"), F.col("s_here").alias("a6"), F.col("t").alias("a7"))) == want


@pytest.mark.parametrize("now", [True, False])
@pytest.mark.parametrize("block, span", [(5, 20), (7, 20), (20, 20), (100, 20), (3, 10**6)])
def test_range_max(spark, history, now, block, span):
    rows = frame(spark, history).withColumn("real", F.lit(True)).select("k", "t", "real", "v")
    got = range_max(rows, ["k"], "t", "v", span, include_now=now, block_ms=block)
    want = {}
    for k, t in {(h[0], h[1]) for h in history}:
        seen = [h[2] for h in history if h[0] == k and t - span <= h[1] <= (t if now else t - 1)]
        want[(k, t, max(seen, default=None))] = 1
    assert rows_of(got) == want


@pytest.mark.parametrize("block", [1, 9, 1000])
def test_recent(spark, history, block):
    rows = frame(spark, history).select("k", "t", F.struct("t", "id").alias("item"))
    got = recent(rows, ["k"], "t", "item", 3, block_ms=block).select("k", "t", F.transform("recent", lambda i: i["id"]).alias("ids"))
    want = {}
    for k, t in {(h[0], h[1]) for h in history}:
        mine = sorted(((h[1], h[3]) for h in history if h[0] == k and h[1] < t), reverse=True)[:3]
        want[(tuple(i for _, i in mine), k, t)] = 1
    assert rows_of(got.select(F.col("ids").alias("a"), F.col("k").alias("b"), F.col("t").alias("c"))) == want


def test_coverage_counts_distinct_members(spark, history):
    pairs = sorted({(h[0], h[2], h[1]) for h in history})
    steps = []
    for k, m, t in pairs:
        earlier = [x[2] for x in pairs if x[:2] == (k, m) and x[2] < t]
        steps.append((k, t, max(earlier, default=None)))
    deltas = coverage(spark.createDataFrame(steps, "k string, t long, p long"), ["k"], "t", "p", 10, "n")
    rows = frame(spark, history).select("k", "t", F.lit(True).alias("real"), F.lit(None).cast("bigint").alias("n"))
    got = scan(rows, ["k"], "t", [Measure("n")], deltas=deltas, block_ms=7)
    want = {(k, len({h[2] for h in history if h[0] == k and t - 10 <= h[1] <= t}), t): 1 for k, t in {(h[0], h[1]) for h in history}}
    assert rows_of(got) == want

from pyspark.sql import functions as F

from payscope.operators.timeline import Measure, scan


def test_greatest_of_a_moment_comes_with_it(spark):
    rows = spark.createDataFrame([(1, 10, 5), (1, 10, 7), (1, 20, 3)], "k int, t long, v int").withColumn("real", F.lit(True))
    got = sorted(tuple(r) for r in scan(rows, ["k"], "t", [Measure("v", "max", here=True)]).collect())
    assert got == [(1, 10, None, 7), (1, 20, 7, 3)]


def test_contribution_here_leaves_out_deltas_and_what_is_taken_back(spark):
    rows = spark.createDataFrame([(1, 10, 2), (1, 16, 4)], "k int, t long, n long").withColumn("real", F.lit(True))
    deltas = spark.createDataFrame([(1, 16, 100)], "k int, t long, n long")
    got = sorted(tuple(r) for r in scan(rows, ["k"], "t", [Measure("n", range_ms=5, here=True)], deltas=deltas).collect())
    assert got == [(1, 10, 2, 2), (1, 16, 104, 4)]

"""Results stored by family, judged payments, the log of a stream, and the shuffle files of staged rows."""
import time

import pytest
from pyspark.sql import functions as F

from payscope.config.rules import rule_config
from payscope.operators.outcome import JUDGED
from payscope.operators.rules import evaluate_rules
from payscope.sources import shared
from payscope.sources.adapters import pay
from payscope.streaming.evaluate import StreamEvaluator
from tests.conftest import rows_of, skewed_events


def test_shuffle_files_go_with_the_write(spark):
    """The setting is on while staged rows are written and as before afterwards, also if the write fails."""
    before = spark.conf.get(shared.DROP_SHUFFLES)
    seen = []
    with shared.dropping_shuffles(spark):
        with shared.dropping_shuffles(spark):
            seen.append(spark.conf.get(shared.DROP_SHUFFLES))
        seen.append(spark.conf.get(shared.DROP_SHUFFLES))
    assert seen == ["true", "true"] and spark.conf.get(shared.DROP_SHUFFLES) == before
    with pytest.raises(Exception, match="no number"):
        shared.staged(spark.range(3).select(F.raise_error(F.lit("no number")).cast("int").alias("x")), "fails")
    assert spark.conf.get(shared.DROP_SHUFFLES) == before


def test_staged_rows_leave_no_shuffle_files(spark):
    """They go with the write, whether or not the driver collects garbage."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in manager.getAllFiles().mkString(",").split(",") if "shuffle_" in n}
    before = files()
    rows = spark.range(20000).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n"))
    assert shared.staged(rows, "counted").count() == 997
    end = time.time() + 20
    while (left := {n for n in files() - before if n.endswith(".data")}) and time.time() < end:
        time.sleep(0.2)
    assert len(left) <= 1  # the count is no staged write


def test_only_judged_payments_get_results(spark, tmp_path):
    """All payments are history; the results of the others are not made to be thrown away."""
    docs = [rule_config(r) for r in ("004", "006", "018", "021", "024", "030", "075", "083", "090", "091")]
    rows = pay(spark, str(skewed_events(tmp_path, n=60)))
    some = evaluate_rules(rows.withColumn(JUDGED, F.col("e2e") % 3 == 0), docs)
    assert rows_of(some) == rows_of(evaluate_rules(rows, docs).where("e2e % 3 = 0"))


def test_stream_log_comes_back(spark, tmp_path):
    """With and without values."""
    ev = StreamEvaluator(str(tmp_path), lambda: [], lambda: [])
    ev._log(spark, 0, None)
    ev._log(spark, 1, (5, 3, 4, ["pairs", "tops"]))
    ev._log(spark, 2, (6, None, 7, []))
    assert ev._before(spark, 1) is None
    assert ev._before(spark, 2) == (5, 3, 4, ["pairs", "tops"]) and ev._before(spark, 3) == (6, None, 7, [])

"""The stream, with kept totals of closed days, against one batch over everything, for all rules."""
import pytest
from pyspark.sql import functions as F

from payscope.config.rules import FULL_SET, rule_config
from payscope.operators import kept
from payscope.operators.rules import evaluate_rules
from payscope.plans.catalogue import run_stream
from payscope.sources.adapters import pay
from payscope.streaming.evaluate import StreamEvaluator
from tests.conftest import rows_of, skewed_events

ALL = [*FULL_SET, "901", "902"]
COLUMNS = ["tenant_id", "e2e", "rule_id", "value", "sub_rule_ref"]


def test_all_rules_suit_the_totals():
    assert all(kept.fits(rule_config(r)) for r in ALL)
    assert not kept.fits(rule_config("021", maxQueryRange=None)) and not kept.fits(rule_config("010", evaluationIntervalTime=3_600_000))


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Six days of payments, a slice for each batch, the last one with payments of closed days among them."""
    p = pay(spark, str(skewed_events(tmp_path_factory.mktemp("stream"), n=240)))
    late = F.col("e2e") % 17 == 3
    slice_ = F.floor((F.col("t_ms") - 1_704_067_200_000) / (40 * 3_600_000))
    path = str(tmp_path_factory.mktemp("stored") / "pay")
    p.withColumn("slice", F.when(late, 4).otherwise(slice_)).write.parquet(path)
    return spark.read.parquet(path)


def run(spark, batches, root, rules, slices):
    ev = StreamEvaluator(str(root), lambda: [rule_config(r) for r in rules], lambda: [])
    for no, i in enumerate(slices):
        ev(batches.where(F.col("slice") == i).drop("slice"), no)
    return spark.read.parquet(f"{root}/results").select(*COLUMNS)


def test_stream_equals_batch_for_all_rules(spark, batches, tmp_path):
    """Payments in order; three days are closed before the second batch."""
    ordered = batches.where("slice < 4").withColumn("slice", F.when(F.col("slice") < 2, 0).otherwise(1))
    got = run(spark, ordered, tmp_path, ALL, range(2))
    want = evaluate_rules(ordered.drop("slice"), [rule_config(r) for r in ALL]).select(*COLUMNS)
    assert rows_of(got) == rows_of(want)
    closed = spark.read.parquet(f"{tmp_path}/closed").orderBy("batch_id").collect()
    assert closed[-1]["closed"] > closed[0]["closed"]


def test_late_payments_renew_the_totals(spark, batches, tmp_path):
    """Payments of closed days are judged by all that has arrived, and later payments see them in the totals."""
    rules = ["006", "011", "018", "030", "044", "048", "083"]
    docs = [rule_config(r) for r in rules]
    early, late = batches.where("slice < 3"), batches.where("slice = 4")
    rest = batches.where("slice = 3").withColumn("slice", F.lit(5))
    arrived = early.withColumn("slice", F.lit(0)).unionByName(late).unionByName(rest)
    got = run(spark, arrived, tmp_path, rules, (0, 4, 5))
    want = evaluate_rules(arrived.drop("slice"), docs).select(*COLUMNS)
    of = lambda x, part: rows_of(x.join(part.select("tenant_id", "e2e"), ["tenant_id", "e2e"], "left_semi").select(*COLUMNS))
    assert of(got, rest) == of(want, rest)
    before = evaluate_rules(early.unionByName(late).drop("slice"), docs)
    assert of(got, late) == of(before, late)


def test_tables_are_kept_for_the_rules_at_hand(spark, batches, tmp_path):
    """A stream of bounded rules keeps no totals; a rule that is added later finds its totals made from all history."""
    rules = ["901", "902"]
    ev = StreamEvaluator(str(tmp_path), lambda: [rule_config(r) for r in rules], lambda: [])
    ev(batches.where("slice < 2").drop("slice"), 0)
    ev(batches.where("slice = 2").drop("slice"), 1)
    log = spark.read.parquet(f"{tmp_path}/closed").orderBy("batch_id").collect()
    assert log[-1]["closed"] > log[0]["closed"] and log[-1]["held"] == [] and not (tmp_path / "kept").exists()
    rules += ["006", "018", "044", "048", "083"]
    ev(batches.where("slice = 4").drop("slice"), 2)
    last = batches.where("slice = 3")
    ev(last.drop("slice"), 3)
    got = spark.read.parquet(f"{tmp_path}/results").where("batch_id = 3").select(*COLUMNS)
    want = (evaluate_rules(batches.drop("slice"), [rule_config(r) for r in rules])
            .join(last.select("tenant_id", "e2e"), ["tenant_id", "e2e"], "left_semi").select(*COLUMNS))
    assert rows_of(got) == rows_of(want)

"""Every rule against its independent statement on events with hot accounts, equal times and zero amounts."""
import pytest
from pyspark.sql import functions as F

from oracles.rules import rule_sql, similar_sql
from payscope.config.rules import FULL_SET, rule_config
from payscope.operators.rules import evaluate_rules
from payscope.operators.rules.lists import similar_amounts
from payscope.sources.adapters import pay
from tests.conftest import connect, duck_rows, rows_of, skewed_events

RULES = [*FULL_SET, "901", "902"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return skewed_events(tmp_path_factory.mktemp("skewed"))


@pytest.fixture(scope="module")
def outcomes(spark, folder):
    path = str(folder / "outcomes")
    evaluate_rules(pay(spark, str(folder)), [rule_config(r) for r in RULES]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rule", RULES)
def test_rule(rule, outcomes, folder):
    mine = outcomes.where(F.col("rule_id") == rule).select("tenant_id", "e2e", "value", "sub_rule_ref")
    assert rows_of(mine) == duck_rows(connect(folder), rule_sql(rule))


def test_similar_amounts_without_range(spark, folder):
    docs = {"021": rule_config("021", maxQueryRange=None)}
    found = similar_amounts(pay(spark, str(folder)), docs).select("tenant_id", "e2e", "value", "sub_rule_ref")
    assert rows_of(found) == duck_rows(connect(folder), similar_sql(None))

import threading

import pytest

from payscope.operators.rules import registry
from payscope.operators.rules.registry import evaluate_rules
from payscope.config.rules import rule_config
from payscope.sources.adapters import pay
from payscope.sources.shared import together
from tests.conftest import TESTDATA


def test_families_are_built_side_by_side(spark, monkeypatch):
    """Two families wait for each other while they are built; one after another they never meet."""
    both = threading.Barrier(2, timeout=20)

    def meeting(family):
        def build(rows, docs, *kept):
            both.wait()
            return family(rows, docs, *kept)
        return build
    wanted = {"091", "030"}
    monkeypatch.setattr(registry, "FAMILIES", [(rules, meeting(f) if wanted & set(rules) else f) for rules, f in registry.FAMILIES])
    rows = pay(spark, str(TESTDATA))
    got = evaluate_rules(rows, [rule_config(r) for r in sorted(wanted)]).groupBy("rule_id").count().collect()
    assert {r.rule_id: r["count"] for r in got} == dict.fromkeys(wanted, rows.count())


def test_steps_keep_order_properties_and_errors(spark):
    spark.sparkContext.setLocalProperty("payscope.test", "handed on")
    asked = [lambda i=i: (i, spark.sparkContext.getLocalProperty("payscope.test")) for i in range(9)]
    assert together(spark, asked) == [(i, "handed on") for i in range(9)]

    def fails():
        raise ValueError("step")
    with pytest.raises(ValueError, match="step"):
        together(spark, [lambda: 1, fails])

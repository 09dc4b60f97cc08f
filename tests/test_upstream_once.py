from payscope.operators.rules import evaluate_rule, upstream
from payscope.sources.adapters import pay
from tests.conftest import TESTDATA


def test_upstream_steps_are_stored_once(spark, monkeypatch):
    """The listed payees and the account's line are each read twice, so they are stored."""
    stored, staged = [], upstream.staged

    def noted(rows, name):
        stored.append(name)
        return staged(rows, name)
    monkeypatch.setattr(upstream, "staged", noted)
    evaluate_rule(pay(spark, str(TESTDATA)), "090")
    assert {"upstream-listed", "upstream-line"} <= set(stored) and len(stored) == len(set(stored))

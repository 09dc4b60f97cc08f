from payscope.operators.rules import evaluate_rule
from payscope.sources.adapters import pay
from tests.conftest import TESTDATA


def test_mirroring_scans_its_line_once(spark):
    """The time line is stored, so the join back to the payments reads it and does not scan the history again."""
    for rule in ("024", "027"):
        plan = evaluate_rule(pay(spark, str(TESTDATA)), rule)._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" not in plan

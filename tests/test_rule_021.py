"""The published cases of rule 021: amounts newest first, all settled within one day."""
import pytest
from pyspark.sql import functions as F

from payscope.config.rules import rule_config
from payscope.functions import palette as fp
from payscope.operators.outcome import (BAD_TOLERANCE, NO_BANDS, NO_EXITS, NO_HISTORY, NO_X00, NO_X01, NOT_NUMERIC,
                                        outcome, results, validate_rule_config)
from payscope.operators.rules import evaluate_rules

T0 = 1_675_418_038_069


def config(limit=2, **parameters):
    doc = rule_config("021", **parameters)
    for band in doc["config"]["bands"]:
        for side in ("lowerLimit", "upperLimit"):
            if side in band:
                band[side] = limit
    return doc


def without_exit(doc, ref):
    doc["config"]["exitConditions"] = [e for e in doc["config"]["exitConditions"] if e["subRuleRef"] != ref]
    return doc


def evaluate(spark, amounts, doc, ok=True, age_ms=0):
    """Result for the newest payment of a creditor who received ``amounts`` (newest first)."""
    n = len(amounts)
    rows = [("t", i, "d", "c", float(a), T0 - (i * 1000 + (age_ms if i else 0)), ok or i > 0) for i, a in enumerate(amounts)]
    pay = spark.createDataFrame(rows, "tenant_id string, e2e long, dbtr_acct string, cdtr_acct string, amt double, t_ms long, ok boolean")
    pay = pay.withColumns({"amt": F.col("amt").cast("decimal(18,2)"), "req_ms": F.col("t_ms")})
    assert pay.count() == n
    row = evaluate_rules(pay, [doc]).where("e2e = 0").first()
    return row.sub_rule_ref, row.reason


@pytest.mark.parametrize("amounts, ref", [
    ([2000, 1000, 3000], ".01"), ([2000, 2022, 50000], ".02"), ([1], ".x01"),
    ([1000, 899.99, 900, 900.01, 1099.99, 1100, 1100.01], ".02")])
def test_bands(spark, amounts, ref):
    assert evaluate(spark, amounts, config())[0] == ref


def test_tolerance_is_inclusive(spark):
    amounts = [1000, 899.99, 900, 900.01, 1099.99, 1100, 1100.01]
    assert evaluate(spark, amounts, config(limit=5))[0] == ".02"
    assert evaluate(spark, amounts, config(limit=6))[0] == ".01"


def test_no_range(spark):
    doc = config(maxQueryRange=None)
    assert evaluate(spark, [2000, 2022, 50000], doc, age_ms=10**10)[0] == ".02"
    assert evaluate(spark, [2000, 2022, 50000], config(), age_ms=10**10)[0] == ".x01"


def test_range_is_inclusive(spark):
    assert evaluate(spark, [2000, 2000], config(), age_ms=86400000 - 1000)[0] == ".02"
    assert evaluate(spark, [2000, 2000], config(), age_ms=86400000 - 999)[0] == ".x01"


def test_exits(spark):
    assert evaluate(spark, [5, 5], config(), ok=False) == (".x00", "Unsuccessful transaction")
    assert evaluate(spark, [1], config()) == (".x01", "Insufficient transaction history")
    assert evaluate(spark, [50], without_exit(config(), ".x01")) == (".err", NO_X01)


def test_unsuccessful_without_exit(spark):
    """An unsettled payment without .x00 ends in its error, whatever the history holds."""
    for amounts in ([5], [5, 5], [5, 5, 5]):
        assert evaluate(spark, amounts, without_exit(config(), ".x00"), ok=False) == (".err", NO_X00)


def test_payment_without_a_number(spark):
    rows = [("t", 0, "d", "c", "5.00", T0, True), ("t", 1, "d", "c", "baz", T0 - 1000, True),
            ("t", 2, "d", "c", "7.00", T0 - 86_400_001 - 1000, True)]
    pay = spark.createDataFrame(rows, "tenant_id string, e2e long, dbtr_acct string, cdtr_acct string, amt string, t_ms long, ok boolean")
    pay = pay.withColumns({"amt": F.expr("try_cast(amt as decimal(18,2))"), "req_ms": F.col("t_ms")})
    found = {r.e2e: (r.sub_rule_ref, r.reason) for r in evaluate_rules(pay, [config()]).collect()}
    assert found[0] == found[1] == (".err", NOT_NUMERIC) and found[2][0] == ".x01"


@pytest.mark.parametrize("tolerance, wanted", [(0.5, 3), (0.001, 1), (1.0, 3)])
def test_widest_amounts(spark, tolerance, wanted):
    doc = config(tolerance=tolerance)
    rows = [("t", i, "d", "c", a, T0 + i, True) for i, a in enumerate(["9000000000000000.00", "8500000000000000.00",
                                                                       "9999999999999999.99"])]
    pay = spark.createDataFrame(rows, "tenant_id string, e2e long, dbtr_acct string, cdtr_acct string, amt string, t_ms long, ok boolean")
    pay = pay.withColumns({"amt": F.col("amt").cast("decimal(18,2)"), "req_ms": F.col("t_ms")})
    assert evaluate_rules(pay, [doc]).where("e2e = 2").first().value == wanted


def test_history_errors(spark):
    rows = spark.range(1).select(F.lit("t").alias("tenant_id"), F.lit(0).alias("e2e"), F.lit(True).alias("ok"),
                                 F.array(F.lit("baz"), F.lit("bar"), F.lit("foo")).alias("amounts"))
    numbers, bad = fp.map_amounts(F.col("amounts"))
    row = results(rows, [outcome(config(), F.size(numbers), None, F.when(bad, F.lit(NOT_NUMERIC)))]).first()
    assert (row.sub_rule_ref, row.reason) == (".err", NOT_NUMERIC)
    row = results(rows, [outcome(config(), F.lit(0), None, F.lit(NO_HISTORY))]).first()
    assert (row.sub_rule_ref, row.reason) == (".err", NO_HISTORY)


@pytest.mark.parametrize("breakage, message", [
    (lambda c: c.pop("bands"), NO_BANDS), (lambda c: c.pop("exitConditions"), NO_EXITS),
    (lambda c: c["parameters"].pop("tolerance"), BAD_TOLERANCE),
    (lambda c: c["parameters"].update(tolerance="zero point two"), BAD_TOLERANCE)])
def test_invalid_config(breakage, message):
    doc = config()
    breakage(doc["config"])
    with pytest.raises(ValueError) as failure:
        validate_rule_config(doc, ("tolerance",))
    assert str(failure.value) == message

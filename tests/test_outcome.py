"""Both sides of every band limit, cases, exits and missing exits of every rule configuration."""
import pytest
from pyspark.sql import functions as F

from payscope.config.rules import ALL_RULES, RULES, rule_config, tenant_rule_configs
from payscope.config.typologies import TYPOLOGIES
from payscope.operators.outcome import UNHANDLED, outcome, results
from payscope.operators.typology import expression_terms, typology_expression


def test_every_limit(spark):
    rows, expected = [], {}
    for rule in RULES:
        for ref, lo, hi, _ in RULES[rule][3]:
            for value in ([lo] if lo is not None else []) + ([hi - 1e-6, hi] if hi is not None else [1e12]):
                inside = (lo is None or value >= lo) and (hi is None or value < hi)
                if inside:
                    expected[(rule, round(float(value), 6))] = ref
                rows.append((rule, float(value)))
    frame = spark.createDataFrame(sorted(set(rows)), "rule string, v double").selectExpr(
        "'t' AS tenant_id", "monotonically_increasing_id() AS e2e", "true AS ok", "rule", "v")
    answers = [outcome(rule_config(r), F.when(F.col("rule") == r, F.col("v"))) for r in RULES]
    got = {(r.rule_id, r.value): (r.sub_rule_ref, r.reason) for r in results(frame, answers).collect() if r.value is not None}
    assert {k: v[0] for k, v in got.items()} == expected
    texts = {(r, b[0]): b[3] for r in RULES for b in RULES[r][3]}
    assert all(reason == texts[(key[0], ref)] for key, (ref, reason) in got.items())


def test_cases(spark):
    frame = spark.createDataFrame([("t", i, True, k) for i, k in enumerate(["MP2B", "MP2P", "CASH", "X", None])],
                                  "tenant_id string, e2e long, ok boolean, k string")
    got = [r.sub_rule_ref for r in results(frame, [outcome(rule_config("078"), F.col("k"))]).orderBy("e2e").collect()]
    assert got == [".01", ".02", ".03", ".00", ".err"]


def test_exit_outranks_band_and_unknown_exit_is_an_error(spark):
    frame = spark.createDataFrame([("t", 0, True), ("t", 1, False)], "tenant_id string, e2e long, ok boolean")
    got = results(frame, [outcome(rule_config("006"), F.lit(5), F.lit(".x01")),
                          outcome(rule_config("044"), F.lit(None).cast("double")),
                          outcome(rule_config("901"), F.lit(5), F.lit(".x03"))]).collect()
    assert {(r.e2e, r.rule_id): r.sub_rule_ref for r in got} == {
        (0, "006"): ".x01", (0, "044"): ".err", (0, "901"): ".err", (1, "006"): ".x00", (1, "044"): ".err", (1, "901"): ".x00"}
    assert {r.reason for r in got if r.sub_rule_ref == ".err"} == {UNHANDLED}


def test_documents_are_complete():
    assert len(ALL_RULES) == 35
    full = TYPOLOGIES["000"]
    assert len(expression_terms(full["expression"])) == 33 and len(full["rules"]) == 34
    best = {r["id"]: max(float(w["wght"]) for w in r["wghts"]) for r in full["rules"]}
    assert best["007@4.0.0"] == 400 and best["EFRuP@4.0.0"] == 0
    assert tenant_rule_configs()[0]["config"]["bands"][0]["reason"] == "The debtor has performed one transaction to date"


def test_expression_refuses_other_operators():
    with pytest.raises(ValueError):
        expression_terms(["Multiply", "a", "b"])
    assert expression_terms(["Add", "a", ["Add", "b", "a"]]) == ["a", "b", "a"]
    assert typology_expression is not None

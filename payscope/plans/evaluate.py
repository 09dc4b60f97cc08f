"""The evaluation of a payment history: rules, weights, scores, decisions; and back-testing of changed rules."""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import typology as ty
from ..operators.rules import evaluate_rules


@dataclass
class Evaluation:
    results: DataFrame
    scores: DataFrame
    decisions: DataFrame
    status: DataFrame


def score_results(results: DataFrame, typologies: Sequence[dict], flow: DataFrame | None = None) -> Evaluation:
    spark = results.sparkSession
    scores = ty.typology_score(ty.rule_weight(results, ty.weight_table(spark, typologies)))
    decisions = ty.typology_decision(scores, ty.typology_table(spark, typologies), flow)
    return Evaluation(results, scores, decisions, ty.adjudicate(decisions))


def evaluate(pay: DataFrame, rules: Sequence[dict], typologies: Sequence[dict],
             flow: DataFrame | None = None) -> Evaluation:
    """Batch evaluation of every payment under one set of configurations."""
    return score_results(evaluate_rules(pay, rules), typologies, flow)


def evaluate_tenants(pay: DataFrame, rules: Sequence[dict], typologies: Sequence[dict]) -> DataFrame:
    """Per-tenant configurations: each tenant's payments under its own documents; decisions of all tenants.

    Documents of several tenants that decide alike (same rule, configuration, parameters, limits) are evaluated in one
    pass over the payments of all these tenants; scores, thresholds and weights are looked up by tenant in one plan.
    """
    alike: dict[str, list[dict]] = {}
    for doc in rules:
        deciding = {**doc["config"], **{part: [{k: v for k, v in x.items() if k != "reason"} for x in doc["config"].get(part) or []]
                                        for part in ("bands", "exitConditions")}}
        alike.setdefault(json.dumps([doc["id"], doc["cfg"], deciding], sort_keys=True), []).append(doc)
    shared: dict[tuple[str, ...], list[dict]] = {}
    for same in alike.values():
        shared.setdefault(tuple(sorted(d["tenantId"] for d in same)), []).append(same[0])
    results = None
    for tenants, docs in shared.items():
        part = evaluate_rules(pay.where(F.col("tenant_id").isin(*tenants)), docs)
        results = part if results is None else results.unionByName(part)
    return score_results(results, typologies).decisions


def rule_backtest(pay: DataFrame, current: Sequence[dict], changed: Sequence[dict]) -> DataFrame:
    """How outcomes move when rule configurations change: (rule_id, old_ref, new_ref, events)."""
    key = ["tenant_id", "e2e", "rule_id"]
    old = evaluate_rules(pay, current).select(*key, F.col("sub_rule_ref").alias("old_ref"))
    new = evaluate_rules(pay, changed).select(*key, F.col("sub_rule_ref").alias("new_ref"))
    return (old.join(new, key, "full_outer").groupBy("rule_id", "old_ref", "new_ref")
            .agg(F.count(F.lit(1)).alias("events")))

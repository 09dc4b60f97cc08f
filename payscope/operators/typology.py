"""Routing, weights, typology scores, thresholds, event-flow override, adjudication, reports."""
from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_BROADCAST_ROWS = 100_000
DEFAULT_TENANT = "DEFAULT"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A configuration table. Its length is known here, so it is broadcast only within a fixed bound.

    Without the hint Spark knows no size for driver rows and would shuffle every rule result by rule id. The rows are a
    constant of the plan: a distributed list would start Python workers whenever the table is read.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    table = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_ROWS else table


def expand_map(spark: SparkSession, maps: Iterable[Mapping]) -> DataFrame:
    """Routes of the active network maps: (tenant_id, tx_tp, typology_cfg, rule_id, rule_cfg)."""
    rows = [(m["tenantId"], msg["txTp"], t["id"], t["cfg"], r["id"].split("@")[0], r["cfg"])
            for m in maps if m["active"] for msg in m["messages"] for t in msg["typologies"] for r in t["rules"]]
    return _table(spark, rows, "tenant_id string, tx_tp string, typology_id string, typology_cfg string, "
                               "rule_id string, rule_cfg string")


def active_network_map(maps: DataFrame) -> DataFrame:
    """The active map per tenant with a flag for tenants that break the one-active-map rule."""
    active = maps.where("active")
    counts = active.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    return active.join(counts, "tenant_id").select("tenant_id", "cfg", (F.col("n") == 1).alias("unique"))


def route_event(events: DataFrame, routes: DataFrame) -> DataFrame:
    """(event, typology, rule) per routed rule; the route table is configuration-sized."""
    return events.join(routes, ["tenant_id", "tx_tp"])


def resolve_config(routes: DataFrame, configs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(resolved, missing) references to configuration rows."""
    return routes.join(configs, list(keys)), routes.join(configs, list(keys), "left_anti").select(*keys).distinct()


def rule_table(spark: SparkSession, docs: Iterable[Mapping]) -> DataFrame:
    return _table(spark, [(d["id"].split("@")[0], d["cfg"], d["tenantId"], d["desc"]) for d in docs],
                  "rule_id string, rule_cfg string, tenant_id string, description string")


def _shadowed(docs: Sequence[Mapping]) -> dict[tuple, list[str]]:
    """For each default typology (id, cfg) the tenants that have their own: it does not serve them."""
    own: dict[tuple, list[str]] = {}
    for d in docs:
        if d["tenantId"] != DEFAULT_TENANT:
            own.setdefault((d["id"], d["cfg"]), []).append(d["tenantId"])
    return own


def _hidden_from(doc: Mapping, shadowed: Mapping[tuple, list[str]]) -> list[str]:
    return sorted(set(shadowed.get((doc["id"], doc["cfg"]), ()))) if doc["tenantId"] == DEFAULT_TENANT else []


def typology_table(spark: SparkSession, docs: Iterable[Mapping]) -> DataFrame:
    docs = list(docs)
    shadowed = _shadowed(docs)
    rows = {(d["id"], d["cfg"], d["tenantId"]): (
        d["id"], d["cfg"], d["tenantId"], d["workflow"].get("alertThreshold"), d["workflow"].get("interdictionThreshold"),
        d["workflow"].get("flowProcessor"), _hidden_from(d, shadowed)) for d in docs}
    return _table(spark, list(rows.values()), "typology_id string, typology_cfg string, tenant_id string, alert_threshold long, "
                                              "interdiction_threshold long, flow_processor string, shadowed array<string>")


def weight_table(spark: SparkSession, docs: Iterable[Mapping]) -> DataFrame:
    """Weights of all typologies by outcome, a row for each rule of each; ``factor`` is how often the typology's expression
    adds the rule's term."""
    docs = list(docs)
    shadowed, rows = _shadowed(docs), {}
    for d in docs:
        terms = expression_terms(d["expression"])
        for rule in d["rules"]:
            key = (d["tenantId"], d["id"], d["cfg"], rule["id"].split("@")[0], rule["cfg"], rule["termId"])
            rows[key] = (*key, terms.count(rule["termId"]), _hidden_from(d, shadowed),
                         {w["ref"]: float(w["wght"]) for w in rule["wghts"]})
    return _table(spark, list(rows.values()), "owner string, typology_id string, typology_cfg string, rule_id string, cfg string, "
                                              "term_id string, factor int, shadowed array<string>, by_ref map<string,double>")


def _served(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows joined to the configuration of their tenant, and to default configuration that the tenant has no own for. The
    owner is part of the key, so rows do not meet other tenants' configuration."""
    owners = F.explode(F.array_distinct(F.array("tenant_id", F.lit(DEFAULT_TENANT))))
    return (rows.withColumn("owner", owners).join(table, ["owner", *keys])
            .where(~F.coalesce(F.array_contains("shadowed", F.col("tenant_id")), F.lit(False))).drop("owner", "shadowed"))


def expression_terms(expression: Sequence) -> list[str]:
    """Term ids an expression adds up. Only ``Add`` exists; any other operator is refused."""
    operator, *args = expression
    if operator != "Add":
        raise ValueError(f"unsupported typology operator {operator}")
    out: list[str] = []
    for a in args:
        out.extend(expression_terms(a) if isinstance(a, (list, tuple)) else [a])
    return out


def typology_expression(expression: Sequence, term: Mapping[str, Column]) -> Column:
    """The expression as a Column over term columns."""
    total = F.lit(0.0)
    for t in expression_terms(expression):
        total = total + F.coalesce(term[t], F.lit(0.0))
    return total


def rule_weight(results: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of each outcome in each typology of its tenant that names the rule in this configuration; an outcome the
    typology does not list weighs 0 and is flagged (ours)."""
    return (_served(results, weights, ["rule_id", "cfg"])
            .withColumn("weight", F.col("by_ref")[F.col("sub_rule_ref")])
            .withColumn("unknown_ref", F.col("weight").isNull()).na.fill({"weight": 0.0}).drop("by_ref"))


def typology_score(weighted: DataFrame) -> DataFrame:
    """Score per (event, typology) and the rules behind it; partial sums run before the shuffle."""
    return weighted.groupBy("tenant_id", "e2e", "typology_id", "typology_cfg").agg(
        F.sum(F.col("weight") * F.col("factor")).alias("score"), F.count(F.lit(1)).alias("rules_seen"),
        F.max("unknown_ref").alias("unknown_ref"))


def rule_result_collect(results: DataFrame, routes: DataFrame) -> DataFrame:
    """Outcomes per (event, typology) and whether every routed rule has answered; lists are configuration-sized."""
    typology = ["tenant_id", "typology_id", "typology_cfg"]
    members = routes.select(*typology, "rule_id", F.col("rule_cfg").alias("cfg")).distinct()
    expected = members.groupBy(*typology).agg(F.count(F.lit(1)).alias("expected"))
    got = (results.join(members, ["tenant_id", "rule_id", "cfg"]).groupBy("e2e", *typology)
           .agg(F.sort_array(F.collect_set(F.concat("rule_id", "sub_rule_ref"))).alias("outcomes"),
                F.countDistinct("rule_id", "cfg").alias("seen")))
    return got.join(expected, typology).select(
        "tenant_id", "e2e", "typology_id", "typology_cfg", "outcomes", (F.col("seen") == F.col("expected")).alias("complete"))


def typology_decision(scores: DataFrame, typologies: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Alert and interdiction per (event, typology); thresholds are inclusive.

    With ``flow`` (tenant_id, e2e, outcome) a block forces interdiction where the typology names a flow processor,
    an override suppresses it (ours). A typology without an interdiction threshold never interdicts by score.
    """
    rows = _served(scores, typologies.withColumnRenamed("tenant_id", "owner"), ["typology_id", "typology_cfg"])
    at_least = lambda c: F.coalesce(F.col("score") >= F.col(c), F.lit(False))
    interdict = at_least("interdiction_threshold")
    if flow is not None:
        rows = rows.join(flow, ["tenant_id", "e2e"], "left")
        governed = F.col("flow_processor").isNotNull()
        interdict = (F.when(governed & F.col("outcome").isin("overridable-block", "non-overridable-block"), F.lit(True))
                     .when(governed & (F.col("outcome") == "override"), F.lit(False)).otherwise(interdict))
    return rows.select("tenant_id", "e2e", "typology_id", "typology_cfg", "score", at_least("alert_threshold").alias("alert"),
                       interdict.alias("interdict"))


def adjudicate(decisions: DataFrame) -> DataFrame:
    """Event status: ALRT if any typology alerts or interdicts, else NALT."""
    return decisions.groupBy("tenant_id", "e2e").agg(
        F.when(F.max(F.col("alert") | F.col("interdict")), "ALRT").otherwise("NALT").alias("status"),
        F.max("interdict").alias("interdict"), F.count(F.when(F.col("alert"), 1)).alias("typologies_alerted"))


def evaluation_report(pay: DataFrame, results: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """One nested report per event {transaction, report{status, timestamp, typologies[rules[]]}} as JSON.

    Lists hold the routed typologies and rules, so configuration bounds them.
    """
    typology = ["tenant_id", "e2e", "typology_id", "typology_cfg"]
    rules = (_served(results, members, ["rule_id", "cfg"]).groupBy(*typology)
             .agg(F.sort_array(F.collect_list(F.struct(
                 F.col("rule_id").alias("id"), "cfg", F.col("sub_rule_ref").alias("subRuleRef"), "reason"))).alias("rules")))
    typologies = (decisions.join(rules, typology).groupBy("tenant_id", "e2e")
                  .agg(F.sort_array(F.collect_list(F.struct(
                      F.col("typology_id").alias("id"), F.col("typology_cfg").alias("cfg"), F.col("score").alias("result"), "alert", "interdict",
                      F.col("rules").alias("ruleResults")))).alias("typologies"),
                      F.max(F.col("alert") | F.col("interdict")).alias("_alert")))
    head = pay.select("tenant_id", "e2e", "msg_id", "t_ms", "dbtr_acct", "cdtr_acct", "amt")
    report = F.struct(
        F.struct(F.col("tenant_id").alias("TenantId"), F.col("msg_id").alias("MsgId"), F.col("e2e").alias("EndToEndId"),
                 F.col("amt").alias("Amt")).alias("transaction"),
        F.struct(F.col("t_ms").alias("timestamp"), F.when(F.col("_alert"), "ALRT").otherwise("NALT").alias("status"),
                 "typologies").alias("report"))
    return head.join(typologies, ["tenant_id", "e2e"]).select("tenant_id", "e2e", "msg_id", "t_ms",
                                                              F.to_json(report).alias("evaluation"))


def extract_evaluation(evaluations: DataFrame) -> DataFrame:
    """Timestamp, message id (nested, else flat) and tenant of stored evaluations."""
    nested = ("transaction STRUCT<TenantId: STRING, MsgId: STRING, FIToFIPmtSts: STRUCT<GrpHdr: STRUCT<MsgId: STRING>>>, "
              "report STRUCT<timestamp: STRING>")
    e = evaluations.withColumn("_e", F.from_json("evaluation", nested))
    return e.select(F.col("_e.report.timestamp").alias("cre_dt_tm"), F.coalesce(
        "_e.transaction.FIToFIPmtSts.GrpHdr.MsgId", "_e.transaction.MsgId").alias("message_id"),
        F.col("_e.transaction.TenantId").alias("tenant_id"))


def extract_config(documents: DataFrame) -> DataFrame:
    """id, cfg, tenant, active, created, updated of configuration documents (column ``configuration``)."""
    c = documents.withColumn("_c", F.from_json(
        "configuration", "id STRING, cfg STRING, tenantId STRING, active BOOLEAN, creDtTm STRING, updDtTm STRING"))
    return c.select(F.col("_c.id").alias("id"), F.col("_c.cfg").alias("cfg"), F.col("_c.tenantId").alias("tenant_id"),
                    F.col("_c.active").alias("active"), F.col("_c.creDtTm").alias("cre_dt_tm"),
                    F.col("_c.updDtTm").alias("upd_dt_tm"))


def rule_hit_matrix(results: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Events x rules; the pivot values are given, so no extra pass finds them."""
    return results.groupBy("tenant_id", "e2e").pivot("rule_id", list(rules)).agg(F.max("sub_rule_ref"))

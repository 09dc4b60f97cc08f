"""Every operator as a named query over the stored tables: ``(spark, folder) -> DataFrame``."""
from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.rules import FULL_SET, rule_config, tenant_rule_configs
from ..config.typologies import NETWORK_MAPS, TYPOLOGIES, tenant_typologies, typology_999
from ..functions import palette as fp
from ..operators import conditions as co
from ..operators import history as hi
from ..operators import timeline as tl
from ..operators import typology as ty
from ..operators.outcome import determine_outcome_band, determine_outcome_case, rule_document_faults
from ..operators.rules import evaluate_rule, evaluate_rules, register_rule
from ..sources import messages as ms
from ..sources import tables as tb
from ..sources.adapters import (STATUS, TRANSFER, governed_edges, message_documents, pay, pay_from_events,
                                pay_from_history, pay_once, table)
from ..sources.shared import staged
from ..streaming import evaluate as st
from . import documents as dc
from . import reports as rp
from .evaluate import evaluate, evaluate_tenants, rule_backtest, score_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MARK = {"extract_pacs002": STATUS, "extract_pacs008": TRANSFER, "extract_pain001": ms.PAIN001,
        "extract_pain013": ms.PAIN013}
DAY = 86_400_000
JAN_15 = 1_705_276_800_000  # 2024-01-15


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f
    return add


def _events(spark, d):
    return table(spark, d, "events")


def _docs(spark, d, tx_tp):
    return message_documents(_events(spark, d), tx_tp)


def _extracted(spark, d, tx_tp):
    return ms.extract(_docs(spark, d, tx_tp), tx_tp, keep=["seq"])


def _count_eval(p: DataFrame, flow: DataFrame | None = None):
    return evaluate(p, [rule_config("901"), rule_config("902")], [TYPOLOGIES["999-901"], TYPOLOGIES["999-901-902"]], flow)


def _write(spark, rows, name, partitions=()):
    return tb.write_table(rows, tb.shared_dir(spark, name), "replace", partitions)


# ---- rules -------------------------------------------------------------------------------------------------------

def _rule(rule, spark, d):
    payments = pay_once if rule == "090" else pay  # 090 reads them four times
    return evaluate_rule(payments(spark, d), rule).select("tenant_id", "e2e", "value", "sub_rule_ref")


for _r in [*FULL_SET, "901", "902"]:
    QUERIES[f"rule_{_r}"] = partial(_rule, _r)


@query("rule_021_unbounded")
def _(spark, d):
    return evaluate_rule(pay(spark, d), "021", maxQueryRange=None).select("tenant_id", "e2e", "value", "sub_rule_ref")


@query("event_flow")
def _(spark, d):
    p = pay(spark, d)
    return co.event_flow(p, governed_edges(p))


# ---- intake ------------------------------------------------------------------------------------------------------

def _extract(tx_tp, spark, d):
    return _extracted(spark, d, tx_tp).drop("document", "instd_amt", "intr_bk_sttlm_amt", "xchg_rate", "ccy", "tx_sts")


for _n, _t in MARK.items():
    QUERIES[_n] = partial(_extract, _t)


def _edge_documents(p):
    def doc(tx_tp, mark, at, amt, status):
        return F.to_json(F.struct(
            F.concat(F.lit("E"), F.col("e2e").cast("string")).alias("EndToEndId"), amt.alias("Amt"),
            F.col("ccy").alias("Ccy"), F.concat(F.lit(mark), F.col("e2e").cast("string")).alias("MsgId"),
            F.col(at).cast("string").alias("CreDtTm"), F.lit(tx_tp).alias("TxTp"), status.alias("TxSts"),
            F.col("tenant_id").alias("TenantId")))
    none = F.lit(None)
    return p.select(F.col("dbtr_acct").alias("source"), F.col("cdtr_acct").alias("destination"), F.explode(F.array(
        doc(TRANSFER, "T", "req_ms", F.col("amt"), none.cast("string")),
        doc(STATUS, "S", "t_ms", none.cast("decimal(18,2)"), F.when(F.col("ok"), "ACCC").otherwise("RJCT")))).alias("transaction"))


@query("extract_transaction")
def _(spark, d):
    rows = ms.extract_flat(_edge_documents(pay(spark, d)), "transaction", ms.TRANSACTION_FIELDS)
    return rows.withColumn("amt", F.col("amt").cast("double"))


@query("extract_condition")
def _(spark, d):
    e = governed_edges(pay(spark, d))
    docs = e.select(F.to_json(F.struct(F.col("destination").alias("condId"), F.col("tenant_id").alias("tenantId"),
                                       F.col("incptn_ms").cast("string").alias("creDtTm"),
                                       F.col("xprtn_ms").cast("string").alias("updDtTm"))).alias("condition"))
    return ms.extract_flat(docs, "condition", ms.CONDITION_FIELDS)


def _reports(spark, d):
    p = pay_once(spark, d)
    # scores and report read the results, so they are written once
    results = staged(evaluate_rules(p, [rule_config("901"), rule_config("902")]), "results")
    ev = score_results(results, [TYPOLOGIES["999-901"], TYPOLOGIES["999-901-902"]])
    members = ty.weight_table(spark, [TYPOLOGIES["999-901"], TYPOLOGIES["999-901-902"]]).select(
        "owner", "shadowed", "typology_id", "typology_cfg", "rule_id", "cfg").distinct()
    return ty.evaluation_report(p, ev.results, members, ev.decisions)


@query("extract_evaluation")
def _(spark, d):
    return ty.extract_evaluation(_reports(spark, d))


def _config_documents(spark, d):
    """One stored configuration document per account: derived from the events, so it grows with them."""
    p = pay(spark, d)
    per = p.groupBy("tenant_id", "dbtr_acct").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    return per.select(F.to_json(F.struct(
        F.concat(F.lit("map-"), F.col("dbtr_acct").cast("string")).alias("id"),
        F.concat(F.lit("1."), (F.col("dbtr_acct") % 7).cast("string")).alias("cfg"), F.col("tenant_id").alias("tenantId"),
        (F.col("dbtr_acct") % 50 == 0).alias("active"), F.col("lo").cast("string").alias("creDtTm"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi").cast("string")).alias("updDtTm"))).alias("configuration"))


@query("extract_config")
def _(spark, d):
    return ty.extract_config(_config_documents(spark, d))


@query("validate_message")
def _(spark, d):
    v = ms.validate(_extracted(spark, d, TRANSFER))
    return v.select("seq", "valid", F.concat_ws("; ", "errors").alias("errors"))


@query("quarantine_sink")
def _(spark, d):
    v = ms.validate(_extracted(spark, d, TRANSFER))
    q = ms.quarantine(v, "/v1/evaluate/iso20022/pacs.008.001.10", "c1", "v1", F.lit("2024-02-01").cast("timestamp_ntz"))
    return (_write(spark, q, "quarantine", ["tenant_id"])
            .select("correlation_id", "tenant_id", "endpoint_path", "version", "error", "status"))


@query("dedup_message")
def _(spark, d):
    v = ms.validate(_extracted(spark, d, STATUS)).where("valid")
    return ms.dedup_message(v.drop("errors", "document"), ["cre_dt_tm", "seq"]).select("tenant_id", "message_id", "end_to_end_id", "seq")


@query("referential_check")
def _(spark, d):
    p = pay(spark, d)
    accounts = hi.build_accounts(p).where(F.col("id") % 13 != 5)
    entities = hi.build_entities(p).where(F.col("id") % 17 != 3)
    holders, tx = hi.build_account_holders(p), hi.build_transactions(p)
    return (hi.orphans(holders, "source", entities, "holder_source")
            .unionByName(hi.orphans(holders, "destination", accounts, "holder_destination"))
            .unionByName(hi.orphans(tx, "source", accounts, "transaction_source"))
            .unionByName(hi.orphans(tx, "destination", accounts, "transaction_destination")))


PAYLOAD_MAPPING = {
    "TxTp": {"constant": STATUS}, "MsgId": {"sources": ["$.head.prefix", "$.head.number"], "delimiter": "-"},
    "EndToEndId": {"sources": ["$.head.number"]}, "Amt": {"sources": ["$.money.value"], "type": "double"},
    "Ccy": {"constant": "USD"}, "source": {"sources": ["$.parties[0].acct"], "type": "bigint"},
    "destination": {"sources": ["$.parties[1].acct"], "type": "bigint"}, "TxSts": {"sources": ["$.state"]}}


@query("map_payload")
def _(spark, d):
    p = pay(spark, d)
    payload = F.to_json(F.struct(
        F.struct(F.lit("M").alias("prefix"), F.col("e2e").alias("number")).alias("head"),
        F.struct(F.col("amt").cast("double").alias("value")).alias("money"),
        F.array(F.struct(F.col("dbtr_acct").alias("acct")), F.struct(F.col("cdtr_acct").alias("acct"))).alias("parties"),
        F.when(F.col("ok"), "ACCC").alias("state")))
    return ms.map_payload(p.select(payload.alias("payload")), PAYLOAD_MAPPING)


@query("map_payload_xml")
def _(spark, d):
    p = pay(spark, d)
    payload = F.format_string("<pay><id>%s</id><amt ccy=\"USD\">%s</amt><from>%s</from><to>%s</to></pay>",
                              F.col("e2e"), F.col("amt"), F.col("dbtr_acct"), F.col("cdtr_acct"))
    schema = "id STRING, amt STRUCT<_VALUE: DOUBLE, _ccy: STRING>, from BIGINT, to BIGINT"
    mapping = {"EndToEndId": {"sources": ["id"]}, "Amt": {"sources": ["amt._VALUE"], "type": "double"},
               "Ccy": {"sources": ["amt._ccy"]}, "source": {"sources": ["from"], "type": "bigint"},
               "destination": {"sources": ["to"], "type": "bigint"}, "MsgId": {"sources": ["id", "from"], "delimiter": "/"}}
    return ms.map_payload_xml(p.select(payload.alias("payload")), schema, mapping)


FUNCTION_MAPPING = {
    "Reference": {"sources": ["$.head.prefix", "$.head.number"], "functions": [
        {"name": "concat", "args": ["/"]}, {"name": "lower"}, {"name": "replace", "args": ["m/", "msg-"]}]},
    "Cents": {"sources": ["$.money.value"], "type": "bigint", "functions": [
        {"name": "number"}, {"name": "multiply", "args": [100]}, {"name": "round", "args": [0]}]},
    "Total": {"sources": ["$.money.value", "$.money.fee"], "type": "double", "functions": [{"name": "sum"}]},
    "State": {"sources": ["$.state"], "functions": [
        {"name": "lookup", "args": [{"ACCC": "settled"}]}, {"name": "default", "args": ["open"]}]},
    "Kind": {"sources": ["$.text"], "functions": [
        {"name": "part", "args": ["|", 1]}, {"name": "upper"}, {"name": "substring", "args": [0, 3]}]},
    "Party": {"sources": ["$.missing", "$.parties[1].acct"], "functions": [{"name": "first"}]}}


@query("map_payload_functions")
def _(spark, d):
    p = pay(spark, d)
    payload = F.to_json(F.struct(
        F.struct(F.lit("M").alias("prefix"), F.col("e2e").alias("number")).alias("head"),
        F.struct(F.col("amt").cast("string").alias("value"), F.lit("0.25").alias("fee")).alias("money"),
        F.array(F.struct(F.col("dbtr_acct").alias("acct")), F.struct(F.col("cdtr_acct").alias("acct"))).alias("parties"),
        F.concat_ws("|", F.lit("kind"), F.col("tx_kind")).alias("text"), F.when(F.col("ok"), "ACCC").alias("state")))
    return ms.map_payload(p.select(payload.alias("payload")), FUNCTION_MAPPING)


@query("ingest_pull")
def _(spark, d):
    landed = tb.shared_dir(spark, "landed")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.option("header", True).csv(landed)
    job = {"file": {"path": landed, "format": "csv", "options": {"header": "true"},
                    "schema": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"}}
    path = tb.shared_dir(spark, "pulled")
    tb.ingest_pull(spark, {**job, "mode": "replace"}, path)
    return tb.ingest_pull(spark, {**job, "mode": "append"}, path)


@query("ingest_push")
def _(spark, d):
    path = tb.shared_dir(spark, "pushed")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    tb.ingest_push(c, {"path": "customers", "version": "v1", "mode": "append"}, path)
    tb.ingest_push(c, {"path": "customers", "version": "v2", "mode": "append"}, path)
    tb.ingest_push(c.where("c_custkey % 2 = 0"), {"path": "customers", "version": "v1", "mode": "replace"}, path)
    return spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))


@query("enrich_rows")
def _(spark, d):
    return tb.enrich_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "job-1")


@query("rotate_table")
def _(spark, d):
    root = tb.shared_dir(spark, "rotated")
    name = "accounts_" + root.rsplit("-", 1)[1]
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    tb.rotate_table(spark, name, s, root, "20240101_000000")
    backup = tb.rotate_table(spark, name, s.withColumn("s_name", F.upper("s_name")), root, "20240102_000000")
    return (spark.table(name).withColumn("version", F.lit("current"))
            .unionByName(spark.table(backup).withColumn("version", F.lit("backup"))))


@query("job_history")
def _(spark, d):
    v = ms.validate(_extracted(spark, d, TRANSFER))
    return tb.job_history(v, F.col("valid"), "DEFAULT", "job-1", "PULL")


@query("enrich_join")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return tb.enrich_join(pay(spark, d).select("tenant_id", "e2e", "cdtr_acct"), c, {"cdtr_acct": "c_custkey"})


def _batch_pay(spark, d):
    """Payments rebuilt from message texts: extract, check, de-duplicate, join."""
    kept = {}
    for tx in (STATUS, TRANSFER):
        valid = ms.validate(_extracted(spark, d, tx)).where("valid").drop("document", "errors")
        kept[tx] = ms.dedup_message(valid, ["cre_dt_tm", "seq"])
    cache = hi.data_cache(kept[STATUS], kept[TRANSFER])
    rows = pay_from_history(cache.where("dbtr_acct_id is not null"))
    typed = rows.select("tenant_id", F.col("end_to_end_id").alias("e2e"), "msg_id", F.col("dbtr_acct_id").alias("dbtr_acct"),
                       F.col("cdtr_acct_id").alias("cdtr_acct"), F.col("instd_amt").alias("amt"), "req_ms", "t_ms",
                       (F.col("tx_sts") == "ACCC").alias("ok"))
    return _write(spark, typed, "payments")  # texts are parsed once; every rule then reads typed columns


@query("batch_take_on")
def _(spark, d):
    return _count_eval(_batch_pay(spark, d)).decisions.drop("typology_id")


@query("batch_take_on_unmatched")
def _(spark, d):
    """Statuses that batch take-on cannot evaluate because no transfer has their end-to-end id."""
    kept = {tx: ms.dedup_message(ms.validate(_extracted(spark, d, tx)).where("valid").drop("document", "errors"), ["cre_dt_tm", "seq"])
            for tx in (STATUS, TRANSFER)}
    return hi.unmatched_statuses(kept[STATUS], kept[TRANSFER]).select("tenant_id", "end_to_end_id", "message_id")


@query("etl_extract")
def _(spark, d):
    new = tb.etl_extract(pay(spark, d, since=JAN_15 + 1), "t_ms", JAN_15).select(
        "tenant_id", "e2e", "t_ms", F.floor(F.col("t_ms") / DAY).cast("int").alias("day"))
    return _write(spark, new, "bronze", ["tenant_id", "day"])


@query("lake_upsert")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                         F.lit(1).alias("version"), (F.col("o_orderkey") % 8).cast("int").alias("part"))
    path = tb.shared_dir(spark, "orders")
    o.where("o_orderkey % 3 <> 0").write.partitionBy("part").parquet(path)
    changes = o.where("o_orderkey % 2 = 0").withColumns({"version": F.lit(2), "o_orderstatus": F.lit("U")})
    return tb.lake_upsert(spark, path, changes, ["o_orderkey"], ["version"], "part")


@query("gold_transactions")
def _(spark, d):
    p = pay(spark, d)
    ev = _count_eval(p)
    gold = p.join(ev.status, ["tenant_id", "e2e"]).select(
        "tenant_id", F.floor(F.col("t_ms") / DAY).cast("int").alias("day"), "e2e", "dbtr_acct", "cdtr_acct",
        F.col("amt").cast("double").alias("amt"), "ok", "status")
    return _write(spark, gold, "gold", ["tenant_id", "day"])


@query("evaluation_sink")
def _(spark, d):
    rows = _reports(spark, d).withColumn("day", F.floor(F.col("t_ms") / DAY).cast("int"))
    stored = _write(spark, rows, "evaluation", ["tenant_id", "day"])
    return stored.select("tenant_id", "day", "msg_id", F.get_json_object("evaluation", "$.report.status").alias("status"),
                         F.get_json_object("evaluation", "$.report.typologies[0].result").cast("double").alias("first_score"))


def _sink(kind, spark, d):
    p = pay_once(spark, d)
    flow = co.event_flow(p, governed_edges(p))
    if kind == "eventflow":
        rows = flow.where("outcome <> 'none'")
    else:
        ev = _count_eval(p, flow)
        rows = (ev.status.where("status = 'ALRT'").drop("interdict") if kind == "alert"
                else ev.decisions.where("interdict").select("tenant_id", "e2e", "typology_cfg", "score"))
    return _write(spark, rows, kind, ["tenant_id"])


for _k in ("alert", "interdiction", "eventflow"):
    QUERIES[f"{_k}_sink"] = partial(_sink, _k)


# ---- documents ---------------------------------------------------------------------------------------------------

@query("doc_text_extract")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", dc.doc_text_extract(F.col("html")).alias("text"))


@query("doc_index")
def _(spark, d):
    return dc.doc_index(table(spark, d, "documents"), "doc_id", "text")


@query("doc_search")
def _(spark, d):
    index = tb.shared_dir(spark, "doc-index")
    dc.write_index(table(spark, d, "documents"), "doc_id", "text", index)
    return dc.doc_search(spark, index, ["the", "with", "der", "que"], 20)


# ---- filters -----------------------------------------------------------------------------------------------------

@query("active_network_map")
def _(spark, d):
    return ty.active_network_map(ty.extract_config(_config_documents(spark, d)))


@query("settled_filter")
def _(spark, d):
    return hi.settled_filter(hi.build_transactions(pay(spark, d))).select("tenant_id", "end_to_end_id", "source", "destination", "cre_ms")


@query("time_range_filter")
def _(spark, d):
    near = pay(spark, d, since=JAN_15 - 7 * DAY, before=JAN_15 + 1)
    return hi.time_range_filter(near, "t_ms", JAN_15, 7 * DAY).select("tenant_id", "e2e", "t_ms")


@query("distinct_e2e")
def _(spark, d):
    return hi.distinct_e2e(hi.build_transactions(pay(spark, d)))


@query("condition_updated")
def _(spark, d):
    return co.conditions_of(governed_edges(pay(spark, d))).where("upd_ms is not null").select("tenant_id", "cond_id", "upd_ms")


@query("since_filter")
def _(spark, d):
    c = ty.extract_config(_config_documents(spark, d))
    return c.where(F.col("upd_dt_tm").cast("bigint") >= JAN_15 + 14 * DAY).select("tenant_id", "id", "upd_dt_tm")


@query("rule_status_filter")
def _(spark, d):
    c = ty.extract_config(_config_documents(spark, d))
    return c.where("active AND tenant_id = 'tenant-001' AND cfg >= '1.0'").select("id", "cfg")


# ---- joins -------------------------------------------------------------------------------------------------------

@query("settled_amounts")
def _(spark, d):
    return hi.settled_amounts(hi.build_transactions(pay(spark, d))).withColumn("amt", F.col("amt").cast("double"))


@query("newest_first")
def _(spark, d):
    rows = hi.settled_amounts(hi.build_transactions(pay(spark, d))).select("tenant_id", "end_to_end_id", "cre_ms")
    return hi.newest_first(rows, "cre_ms", "end_to_end_id")


@query("data_cache")
def _(spark, d):
    p = pay(spark, d)
    holders = hi.build_account_holders(p).select("tenant_id", F.col("destination").cast("string").alias("account"),
                                                 F.col("source").alias("entity"))
    valid = {tx: ms.validate(_extracted(spark, d, tx)).where("valid") for tx in (STATUS, TRANSFER)}
    kept = {tx: ms.dedup_message(v.drop("document", "errors"), ["cre_dt_tm", "seq"]) for tx, v in valid.items()}
    c = hi.data_cache(kept[STATUS], kept[TRANSFER], holders)
    return c.select("tenant_id", "end_to_end_id", "msg_id", "dbtr_id", "cdtr_id", "dbtr_acct_id", "cdtr_acct_id",
                    F.col("instd_amt").cast("double").alias("instd_amt"),
                    F.col("intr_bk_sttlm_amt").cast("double").alias("intr_bk_sttlm_amt"), "xchg_rate", "cre_dt_tm")


@query("rel_holder_entity")
def _(spark, d):
    p = pay(spark, d)
    return hi.holder_entities(hi.build_account_holders(p), hi.build_entities(p)).drop("cre_ms")


@query("rel_holder_account")
def _(spark, d):
    p = pay(spark, d)
    return hi.holder_accounts(hi.build_account_holders(p), hi.build_accounts(p)).drop("cre_ms")


@query("rel_governed_subject")
def _(spark, d):
    p = pay(spark, d)
    return hi.governed_subjects(governed_edges(p), hi.build_accounts(p), hi.build_entities(p)).drop("evt_tp")


@query("rel_governed_condition")
def _(spark, d):
    e = governed_edges(pay(spark, d))
    return hi.governed_conditions(e, co.conditions_of(e)).select("tenant_id", "role", "subject_type", "source", "destination", "cond_tp")


@query("rel_tx_destination")
def _(spark, d):
    p = pay(spark, d)
    return hi.tx_destination(hi.build_transactions(p), hi.build_accounts(p)).select(
        "tenant_id", "end_to_end_id", "tx_tp", "destination", "account_cre_ms")


@query("rel_entity_conditions")
def _(spark, d):
    p = pay(spark, d)
    return hi.subject_conditions(hi.build_entities(p), governed_edges(p), "entity").select("tenant_id", "source", "role", "destination")


@query("rel_account_conditions")
def _(spark, d):
    p = pay(spark, d)
    return hi.subject_conditions(hi.build_accounts(p), governed_edges(p), "account").select("tenant_id", "source", "role", "destination")


@query("rel_condition_subjects")
def _(spark, d):
    e = governed_edges(pay(spark, d))
    return hi.condition_subjects(co.conditions_of(e), e)


def _account_tx(direction, spark, d):
    p = pay(spark, d)
    return hi.account_transactions(hi.build_accounts(p), hi.build_transactions(p), direction).select(
        "tenant_id", "source", "destination", "end_to_end_id", "tx_tp")


QUERIES["rel_account_tx_out"] = partial(_account_tx, "out")
QUERIES["rel_account_tx_in"] = partial(_account_tx, "in")


@query("condition_interval_join")
def _(spark, d):
    p = pay(spark, d)
    return co.interval_join(p, governed_edges(p)).select("tenant_id", "e2e", "role", "subject_type", "destination", "outcome")


def _routed(spark, d):
    events = pay(spark, d).select("tenant_id", "e2e", F.lit(STATUS).alias("tx_tp"))
    return events, ty.expand_map(spark, NETWORK_MAPS["tenants"])


@query("route_event")
def _(spark, d):
    events, routes = _routed(spark, d)
    return ty.route_event(events, routes).select("tenant_id", "e2e", "typology_cfg", "rule_id", "rule_cfg")


@query("resolve_rule_config")
def _(spark, d):
    events, routes = _routed(spark, d)
    configs = ty.rule_table(spark, tenant_rule_configs())
    found, missing = ty.resolve_config(ty.route_event(events, routes), configs, ["rule_id", "rule_cfg", "tenant_id"])
    return (found.groupBy("tenant_id", "rule_id", "rule_cfg").agg(F.count(F.lit(1)).alias("events")).withColumn("found", F.lit(True))
            .unionByName(missing.withColumns({"events": F.lit(0).cast("bigint"), "found": F.lit(False)})))


@query("resolve_rule_config_as_of")
def _(spark, d):
    """The version of a rule's configuration in force when a payment was made; one tenant has none for the first days."""
    events = pay(spark, d).select("tenant_id", "e2e", "t_ms", F.lit("901").alias("rule_id"))
    versions = spark.createDataFrame([("tenant-001", "901", 0, "a", 1), ("tenant-001", "901", JAN_15, "b", 3),
                                      ("tenant-001", "901", JAN_15 + 7 * DAY, "c", 2), ("tenant-002", "901", JAN_15 - 5 * DAY, "d", 1)],
                                     "tenant_id string, rule_id string, since long, name string, days int")
    found = tl.as_of(events, versions, ["tenant_id", "rule_id"], "t_ms", "since")
    return found.select("tenant_id", "e2e", "version.name", "version.days")


@query("rule_901_as_of")
def _(spark, d):
    """Rule 901 with a look-back of one day until January 15th and of three days from then on."""
    docs = [{**rule_config("901", maxQueryRange=n * DAY), "validFrom": since} for n, since in ((1, None), (3, JAN_15))]
    return evaluate_rules(pay(spark, d), docs).select("tenant_id", "e2e", "value", "sub_rule_ref")


@query("resolve_typology_config")
def _(spark, d):
    events, routes = _routed(spark, d)
    configs = ty.typology_table(spark, tenant_typologies())
    found, _missing = ty.resolve_config(ty.route_event(events, routes), configs, ["typology_id", "typology_cfg", "tenant_id"])
    return found.select("tenant_id", "e2e", "typology_cfg", "alert_threshold", "interdiction_threshold").distinct()


# ---- aggregation and windows -------------------------------------------------------------------------------------

def _recent_amounts(p, n):
    settled = p.where("ok").select("tenant_id", "dbtr_acct", "t_ms", F.struct("t_ms", "e2e", "amt").alias("item"))
    tail = tl.recent(settled, ["tenant_id", "dbtr_acct"], "t_ms", "item", n)
    return p.where("ok").join(tail, ["tenant_id", "dbtr_acct", "t_ms"])


@query("count_matching")
def _(spark, d):
    rows = _recent_amounts(pay(spark, d), 5)
    values = F.concat(F.array(F.col("amt").cast("double")), F.transform("recent", lambda i: i["amt"].cast("double")))
    return rows.select("tenant_id", "e2e", fp.count_matching(values, 0.25).alias("matching"))


@query("map_amounts")
def _(spark, d):
    texts = F.split(F.concat_ws("|", F.col("amt").cast("string"), F.when(F.col("e2e") % 5 == 0, F.lit("baz")), F.lit("7")), r"\|")
    numbers, bad = fp.map_amounts(texts)
    return pay(spark, d).select("tenant_id", "e2e", F.aggregate(numbers, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
                                .alias("total"), bad.alias("mismatch"))


@query("population_stddev")
def _(spark, d):
    return pay(spark, d).groupBy("tenant_id", "dbtr_acct").agg(
        F.round(fp.population_stddev(F.when(F.col("ok"), F.col("amt").cast("double"))), 6).alias("sd"))


@query("latest_n")
def _(spark, d):
    rows = _recent_amounts(pay(spark, d), 2)
    return rows.select("tenant_id", "e2e", F.size("recent").alias("n_recent"), F.get("recent", 0)["e2e"].alias("prev_1"),
                       F.get("recent", 1)["e2e"].alias("prev_2"))


def _full_results(spark, d):
    return evaluate_rules(pay_once(spark, d), [rule_config(r) for r in FULL_SET], store=True, apart=True)


@query("typology_score")
def _(spark, d):
    ev = score_results(_full_results(spark, d), [TYPOLOGIES["000"]])
    return ev.scores.select("tenant_id", "e2e", "score")


def shadowing_typologies() -> list[dict]:
    """A default typology, a second one of another id under the same cfg, and a tenant's own with three times the weights."""
    default, second, own = typology_999("DEFAULT", "999@4.0.0"), typology_999("DEFAULT", "999@4.0.0"), typology_999("tenant-001", "999@4.0.0")
    second["id"] = "typology-second"
    for rule in own["rules"]:
        for w in rule["wghts"]:
            w["wght"] = 3 * float(w["wght"])
    return [default, second, own]


@query("typology_tenants")
def _(spark, d):
    results = evaluate_rules(pay(spark, d), [rule_config("901"), rule_config("902")])
    return score_results(results, shadowing_typologies()).decisions


@query("rule_result_collect")
def _(spark, d):
    p = pay(spark, d)
    res = evaluate_rules(p, [rule_config("901"), rule_config("902")])
    routes = ty.expand_map(spark, NETWORK_MAPS["tenants"]).where("rule_id <> 'EFRuP'")
    return ty.rule_result_collect(res, routes).withColumn("outcomes", F.array_join("outcomes", ",")).drop("typology_id")


@query("tenant_rollup")
def _(spark, d):
    return rp.tenant_rollup(pay(spark, d))


# ---- rule framework ----------------------------------------------------------------------------------------------

@query("determine_outcome_band")
def _(spark, d):
    bands = [{"subRuleRef": ".01", "upperLimit": 10}, {"subRuleRef": ".02", "lowerLimit": 10, "upperLimit": 40},
             {"subRuleRef": ".03", "lowerLimit": 40}]
    return table(spark, d, "lineitem").groupBy(determine_outcome_band(F.col("l_quantity"), bands).alias("ref")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("determine_outcome_case")
def _(spark, d):
    cases = {"expressions": [{"subRuleRef": ".01", "value": "1-URGENT"}, {"subRuleRef": ".02", "value": "2-HIGH"}],
             "alternative": {"subRuleRef": ".00"}}
    return table(spark, d, "orders").groupBy(determine_outcome_case(F.col("o_orderpriority"), cases).alias("ref")).agg(
        F.count(F.lit(1)).alias("n"))


@query("exit_condition")
def _(spark, d):
    r = evaluate_rule(pay(spark, d), "021")
    return r.where("sub_rule_ref in ('.x00', '.x01')").select("tenant_id", "e2e", "sub_rule_ref", "reason")


@query("rule_err")
def _(spark, d):
    p = pay(spark, d).withColumn("birth_date", F.when(F.col("dbtr_acct") % 4 != 0, F.col("birth_date")))
    return evaluate_rule(p, "028").select("tenant_id", "e2e", "value", "sub_rule_ref", "reason")


@query("history_errors")
def _(spark, d):
    doc = rule_config("021")
    doc["config"]["exitConditions"] = [e for e in doc["config"]["exitConditions"] if e["subRuleRef"] != ".x01"]
    r = evaluate_rules(pay(spark, d), [doc])
    return r.groupBy("sub_rule_ref", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("validate_rule_config")
def _(spark, d):
    """Stored rule documents, one for each part, whose key decides which fault they have."""
    fault = F.col("p_partkey") % 6
    members = F.concat_ws(
        ",", F.when(fault == 3, '"parameters":{}').when(fault == 4, '"parameters":{"tolerance":"zero point two"}')
        .otherwise(F.concat(F.lit('"parameters":{"tolerance":'), F.lit("0."), F.col("p_size"), F.lit("}"))),
        F.when(fault != 2, '"exitConditions":[{"subRuleRef":".x00","reason":"Unsuccessful transaction"}]'),
        F.when(fault == 5, '"bands":[]').when(fault != 1, '"bands":[{"subRuleRef":".01","upperLimit":2,"reason":"few"}]'))
    docs = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit('{"id":"rule-'), "p_partkey", F.lit('","cfg":"1.0.0","config":{'), members, F.lit("}}"))
        .alias("configuration"))
    faults = rule_document_faults(docs, "configuration", ("tolerance",))
    return faults.select(F.get_json_object("configuration", "$.id").alias("id"), "error")


# ---- typology ----------------------------------------------------------------------------------------------------

@query("rule_weight")
def _(spark, d):
    res = evaluate_rules(pay(spark, d), [rule_config("901"), rule_config("902")])
    w = ty.rule_weight(res, ty.weight_table(spark, [TYPOLOGIES["999-901-902"]]))
    return w.select("tenant_id", "e2e", "rule_id", "sub_rule_ref", "weight", "unknown_ref")


@query("typology_expression")
def _(spark, d):
    res = evaluate_rules(pay(spark, d), [rule_config("901"), rule_config("902")])
    doc = TYPOLOGIES["999-901-902"]
    w = ty.rule_weight(res, ty.weight_table(spark, [doc]))
    terms = ty.expression_terms(doc["expression"])
    wide = w.groupBy("tenant_id", "e2e").agg(*[F.sum(F.when(F.col("term_id") == t, F.col("weight"))).alias(t) for t in terms])
    return wide.select("tenant_id", "e2e", ty.typology_expression(doc["expression"], {t: F.col(t) for t in terms}).alias("score"))


def _decision(column, spark, d):
    return _count_eval(pay(spark, d)).decisions.select("tenant_id", "e2e", "typology_cfg", "score", column)


QUERIES["typology_alert"] = partial(_decision, "alert")
QUERIES["typology_interdict"] = partial(_decision, "interdict")


@query("flow_override")
def _(spark, d):
    p = pay(spark, d)
    return _count_eval(p, co.event_flow(p, governed_edges(p))).decisions.drop("typology_id")


@query("adjudicate")
def _(spark, d):
    p = pay(spark, d)
    return _count_eval(p, co.event_flow(p, governed_edges(p))).status


@query("evaluate_tenants")
def _(spark, d):
    return evaluate_tenants(pay(spark, d), tenant_rule_configs(), tenant_typologies()).drop("typology_id")


@query("evaluation_report")
def _(spark, d):
    r = _reports(spark, d)
    parsed = F.from_json("evaluation", "transaction STRUCT<MsgId: STRING, Amt: DOUBLE>, report STRUCT<status: STRING, "
                                       "typologies: ARRAY<STRUCT<cfg: STRING, result: DOUBLE, alert: BOOLEAN, "
                                       "ruleResults: ARRAY<STRUCT<id: STRING, subRuleRef: STRING>>>>>")
    flat = r.select("tenant_id", "e2e", parsed.alias("j")).select(
        "tenant_id", "e2e", F.col("j.transaction.MsgId").alias("msg_id"), F.col("j.report.status").alias("status"),
        F.explode("j.report.typologies").alias("t"))
    return flat.select("tenant_id", "e2e", "msg_id", "status", F.col("t.cfg").alias("cfg"), F.col("t.result").alias("score"),
                       F.array_join(F.transform("t.ruleResults", lambda x: F.concat(x["id"], x["subRuleRef"])), ",").alias("rules"))


@query("rule_hit_matrix")
def _(spark, d):
    rules = ["044", "045", "091", "901", "902"]
    m = ty.rule_hit_matrix(evaluate_rules(pay(spark, d), [rule_config(r) for r in rules]), rules)
    return m.withColumnsRenamed({r: f"r{r}" for r in rules})


# ---- graph and CRUD ----------------------------------------------------------------------------------------------

@query("build_entities")
def _(spark, d):
    return hi.build_entities(pay(spark, d))


@query("build_accounts")
def _(spark, d):
    return hi.build_accounts(pay(spark, d))


@query("build_account_holders")
def _(spark, d):
    return hi.build_account_holders(pay(spark, d))


@query("build_transactions")
def _(spark, d):
    return hi.build_transactions(pay(spark, d)).withColumn("amt", F.col("amt").cast("double"))


@query("insert_rows")
def _(spark, d):
    p = pay(spark, d)
    known = hi.build_accounts(p).where(F.col("id") % 2 == 0)
    new = p.select("tenant_id", F.col("cdtr_acct").alias("id"), "req_ms")
    return tb.insert_rows(known, new, ["tenant_id", "id"], ["req_ms"])


@query("table_update")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changes = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return tb.update_rows(o, changes, ["o_orderkey"], ["o_orderstatus"])


@query("table_delete")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tb.delete_rows(o, o.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])


@query("table_select")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("condition_admin")
def _(spark, d):
    e = governed_edges(pay(spark, d))
    expired = e.where(F.col("source") % 30 == 0).withColumn("xprtn_ms", F.lit(JAN_15))
    created = e.where(F.col("source") % 40 == 0).withColumn("destination", F.concat(F.lit("N"), "destination"))
    return co.condition_admin(e, expired.unionByName(created)).drop("evt_tp")


@query("conditions_at")
def _(spark, d):
    return co.conditions_at(governed_edges(pay(spark, d)), JAN_15).select("tenant_id", "role", "subject_type", "source", "destination")


# ---- palette -----------------------------------------------------------------------------------------------------

@query("fn_math")
def _(spark, d):
    m, x = fp.MATH, F.col("l_discount")
    q = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.round(m["sqrt"](q), 6).alias("r_sqrt"), m["abs"](x - 0.05).alias("r_abs"),
        F.round(m["pow"](F.col("l_quantity"), F.lit(1.5)), 6).alias("r_pow"), F.round(m["sin"](F.col("l_quantity")), 6).alias("r_sin"),
        F.round(m["cos"](F.col("l_quantity")), 6).alias("r_cos"), F.round(m["asin"](x), 6).alias("r_asin"))


@query("fn_string")
def _(spark, d):
    s, c = fp.STRING, F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.size(s["split"](c, "/")).alias("parts"), s["slice"](c, -5).alias("tail"), s["slice"](c, 2, 7).alias("mid"),
        s["trim"](F.concat(F.lit("  "), c, F.lit(" "))).alias("trimmed"), s["substring"](c, 9, 4).alias("sub"),
        s["toUpperCase"](c).alias("upper"), s["toLowerCase"](c).alias("lower"), s["toString"](F.col("page_id")).alias("text"),
        s["length"](c).alias("size"))


def _amount_array():
    q = F.floor(F.col("l_quantity")).cast("bigint")
    return F.array(q, F.col("l_linenumber").cast("bigint"), F.col("l_partkey") % 10, q + 1)


@query("fn_array")
def _(spark, d):
    a, arr = fp.ARRAY, _amount_array()
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", text(a["pop"](arr)).alias("popped"), text(a["push"](arr, F.lit(9).cast("bigint"))).alias("pushed"),
        text(a["reverse"](arr)).alias("reversed"), text(a["flat"](F.array(arr, arr))).alias("flat"), text(a["concat"](arr, arr)).alias("joined"),
        a["findIndex"](arr, F.col("l_linenumber").cast("bigint")).cast("bigint").alias("found"), a["length"](arr).alias("size"))


@query("fn_loop")
def _(spark, d):
    f, arr = fp.LOOP, _amount_array()
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.array_max(f["map"](arr, lambda x: x * 2)).alias("mapped"),
        F.size(f["filter"](arr, lambda x: x > 5)).alias("kept"), f["every"](arr, lambda x: x > 0).alias("every_one"),
        f["some"](arr, lambda x: x > 40).alias("any_one"),
        f["reduce"](arr, F.lit(0).cast("bigint"), lambda t, x: t + x).alias("total"), f["find"](arr, lambda x: x > 7).alias("first"))


@query("fn_object")
def _(spark, d):
    o = fp.OBJECT
    left = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    right = F.create_map(F.lit("kind"), F.lit("K"), F.lit("id"), F.col("event_id").cast("string"))
    both = o["assign"](left, right)
    return _events(spark, d).select(
        "event_id", F.array_join(F.sort_array(o["keys"](both)), ",").alias("keys"), F.array_join(F.sort_array(o["values"](both)), ",").alias("vals"),
        F.size(o["entries"](both)).alias("entries"), o["hasOwnProperty"](both, F.lit("id")).alias("has_id"),
        o["hasOwnProperty"](left, F.lit("id")).alias("left_has_id"))


@query("fn_if")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(fp.branch(
        (q < 10, F.lit("few")), (q < 30, F.lit("some")), otherwise=F.lit("many")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_ternary")
def _(spark, d):
    p = F.col("o_totalprice")
    nested = fp.branch((F.col("o_orderstatus") == "F", fp.branch((p > 200000, F.lit("big closed")), otherwise=F.lit("closed"))),
                       otherwise=F.lit("other"))
    return table(spark, d, "orders").groupBy(nested.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_stddev")
def _(spark, d):
    arr = F.transform(_amount_array(), lambda x: x.cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", F.round(fp.array_stddev(arr), 6).alias("sd"))


@query("fn_haversine")
def _(spark, d):
    return pay(spark, d).select("e2e", F.round(fp.haversine(F.col("lat"), F.lit(48.2), F.col("lon"), F.lit(16.37)), 6).alias("km"))


@query("fn_sql")
def _(spark, d):
    sql = ("SELECT source, count(*) AS n FROM {tx} WHERE tx_tp = :tp AND tx_sts = :sts AND cre_ms <= :at GROUP BY source")
    return fp.fn_sql(spark, sql, {"tx": hi.build_transactions(pay(spark, d))}, tp=STATUS, sts="ACCC", at=JAN_15)


@query("rule_plugin")
def _(spark, d):
    """A rule added by its author: share of the account's settled outgoing money, banded."""
    def share(p, doc):
        total = p.where("ok").groupBy("tenant_id", "dbtr_acct").agg(F.sum("amt").alias("total"))
        rows = p.where("ok").join(total, ["tenant_id", "dbtr_acct"]).where("total > 0")
        return rows.select("tenant_id", "e2e", (F.col("amt").cast("double") / F.col("total").cast("double")).alias("value"))
    register_rule("950", share)
    doc = {"id": "950@1.0.0", "cfg": "1.0.0", "tenantId": "DEFAULT", "desc": "Share of outgoing money",
           "config": {"parameters": {}, "exitConditions": [{"subRuleRef": ".x00", "reason": "Unsuccessful transaction"}],
                      "bands": [{"subRuleRef": ".01", "upperLimit": 0.1, "reason": "small"},
                                {"subRuleRef": ".02", "lowerLimit": 0.1, "reason": "large"}]}}
    return evaluate_rules(pay(spark, d), [doc]).select("tenant_id", "e2e", "value", "sub_rule_ref")


@query("rule_backtest")
def _(spark, d):
    return rule_backtest(pay(spark, d), [rule_config("901"), rule_config("045")],
                         [rule_config("901", maxQueryRange=3 * DAY), rule_config("045")])


# ---- reports -----------------------------------------------------------------------------------------------------

def _status(spark, d):
    return _count_eval(pay(spark, d)).status


@query("rep_metrics")
def _(spark, d):
    return rp.metrics(_status(spark, d))


@query("rep_executive")
def _(spark, d):
    return rp.executive(pay(spark, d))


@query("rep_fraud_trend")
def _(spark, d):
    return rp.fraud_trend(pay(spark, d), _status(spark, d))


@query("rep_typology_effectiveness")
def _(spark, d):
    return rp.typology_effectiveness(_count_eval(pay(spark, d)).decisions)


@query("rep_rule_outcomes")
def _(spark, d):
    return rp.rule_outcomes(evaluate_rules(pay(spark, d), [rule_config("901"), rule_config("902"), rule_config("044")]))


@query("rep_case_trend")
def _(spark, d):
    return rp.case_trend(rp.cases_from_orders(table(spark, d, "orders")))


@query("rep_case_tracking")
def _(spark, d):
    return rp.case_tracking(rp.cases_from_orders(table(spark, d, "orders")), "1998-12-01")


@query("rep_tms_performance")
def _(spark, d):
    return rp.tms_performance(pay(spark, d))


@query("rep_tms_throughput")
def _(spark, d):
    return rp.tms_throughput(pay(spark, d))


@query("rep_account_network")
def _(spark, d):
    return rp.account_network(pay(spark, d))


@query("rep_counterparty_network")
def _(spark, d):
    return rp.counterparty_network(pay(spark, d))


@query("rep_counterparty_hops")
def _(spark, d):
    p = pay(spark, d)
    return rp.counterparties(p, p.select("tenant_id", F.col("dbtr_acct").alias("account")))


@query("rep_case_lifecycle")
def _(spark, d):
    return rp.case_lifecycle(rp.case_events(table(spark, d, "orders"), table(spark, d, "lineitem")))


@query("rep_alert_history")
def _(spark, d):
    p = pay_once(spark, d)
    return rp.alert_history(p, _count_eval(p).status)


@query("rep_conditions_timeline")
def _(spark, d):
    return rp.conditions_timeline(governed_edges(pay(spark, d)))


@query("rep_transaction_graph")
def _(spark, d):
    return rp.transaction_graph(pay(spark, d))


# ---- streaming ---------------------------------------------------------------------------------------------------

def _event_stream(spark, d):
    return st.file_stream(spark, d, _events(spark, d).schema, "events.parquet")


def _drain(spark, stream, name):
    path = tb.shared_dir(spark, name)
    st.ingest(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_ingest")
def _(spark, d):
    return _drain(spark, pay_from_events(_event_stream(spark, d)).select("tenant_id", "e2e", "t_ms", "ok"), "raw")


@query("stream_dedup")
def _(spark, d):
    twice = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drain(spark, st.dedup(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type"), "dedup")


@query("stream_pair")
def _(spark, d):
    def side(transfer):
        ev = _event_stream(spark, d)
        p = pay_from_events(ev)
        at = F.timestamp_millis(F.col("req_ms" if transfer else "t_ms"))
        rows = p.select("tenant_id", "e2e", at.alias("req_ts" if transfer else "ts"), *(["amt"] if transfer else ["ok"]))
        return rows
    joined = st.pair(side(True), side(False), "1 MINUTE", "10 minutes")
    return _drain(spark, joined.select("tenant_id", "e2e", F.col("amt").cast("double").alias("amt"), "ok"), "pairs")


@query("stream_velocity")
def _(spark, d):
    p = pay_from_events(_event_stream(spark, d)).select("tenant_id", "dbtr_acct", F.timestamp_millis("t_ms").alias("ts"))
    v = st.velocity(p, "dbtr_acct", "ts", "1 day", "1 hour")
    return _drain(spark, v.select("tenant_id", "dbtr_acct", F.unix_millis("window_start").alias("window_ms"), "payments"), "velocity")


STREAM_RULES = [*FULL_SET, "901", "902"]


def run_stream(spark, d, slices: int = 3, rules=None, flow=None, payments=None) -> str:
    """Land the payments in ``slices`` time slices and run the stream after each; returns the output folder."""
    p = pay(spark, d) if payments is None else payments
    root, landing = tb.shared_dir(spark, "stream"), tb.shared_dir(spark, "landing")
    first, width = 1_704_067_200_000, 30 * DAY // slices + 1
    docs = rules or (lambda: [rule_config(r) for r in ("901", "902")])
    ev = st.StreamEvaluator(root, docs, lambda: [TYPOLOGIES["999-901"], TYPOLOGIES["999-901-902"]], flow)
    for i in range(slices):
        lo, hi_ = first + i * width, first + (i + 1) * width
        part = p.where((F.col("t_ms") < hi_) if i == 0 else (F.col("t_ms") >= lo) if i == slices - 1
                       else F.col("t_ms").between(lo, hi_ - 1))
        part.write.mode("append").parquet(landing)
        ev.start(st.file_stream(spark, landing, p.schema)).awaitTermination()
    return root


@query("stream_rules")
def _(spark, d):
    root = run_stream(spark, d, slices=2, rules=lambda: [rule_config(r) for r in STREAM_RULES])
    return spark.read.parquet(f"{root}/results").select("tenant_id", "e2e", "rule_id", "value", "sub_rule_ref")


@query("stream_typology")
def _(spark, d):
    root = run_stream(spark, d)
    return spark.read.parquet(f"{root}/decisions").select("tenant_id", "e2e", "typology_cfg", "score", "alert", "interdict")


@query("stream_alerts")
def _(spark, d):
    root = run_stream(spark, d)
    return spark.read.parquet(f"{root}/alerts").select("tenant_id", "e2e", "status")


@query("stream_config_refresh")
def _(spark, d):
    calls = []

    def rules():
        calls.append(1)
        return [rule_config("901", maxQueryRange=DAY if len(calls) == 1 else 3 * DAY)]
    root = run_stream(spark, d, slices=2, rules=rules)
    return spark.read.parquet(f"{root}/results").select("tenant_id", "e2e", "value", "sub_rule_ref")

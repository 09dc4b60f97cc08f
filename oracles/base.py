"""Shared SQL: the payment table and outcome expressions."""
from __future__ import annotations

from payscope.config.rules import rule_config

PAY = """pay AS (
  SELECT 'tenant-00' || CAST(1 + user_id % 2 AS VARCHAR) AS tenant_id, event_id AS e2e,
         'S' || CAST(event_id AS VARCHAR) AS msg_id,
         user_id // 3 AS dbtr_id, kk // 3 AS cdtr_id, user_id AS dbtr_acct, kk AS cdtr_acct,
         CAST(value AS DECIMAL(18,2)) AS amt, 'USD' AS ccy,
         epoch_us(ts) // 1000 - 1000 * (event_id % 5) AS req_ms, epoch_us(ts) // 1000 AS t_ms, event_type <> 'error' AS ok,
         event_type || CAST(kk AS VARCHAR) AS descr,
         CASE event_type WHEN 'purchase' THEN 'MP2B' WHEN 'click' THEN 'MP2P' WHEN 'view' THEN 'CASH'
              ELSE 'OTHER' END AS tx_kind,
         CAST(-60 + (user_id * 7 + event_id * 13) % 120 AS DOUBLE) AS lat,
         CAST(-180 + (user_id * 11 + event_id * 17) % 360 AS DOUBLE) AS lon,
         DATE '1950-01-01' + CAST((user_id * 397) % 23000 AS INTEGER) AS birth_date
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS kk FROM events)),
act AS (SELECT tenant_id, dbtr_acct AS acct, e2e, t_ms, ok FROM pay
        UNION ALL SELECT tenant_id, cdtr_acct, e2e, t_ms, ok FROM pay)"""


def band(rule: str, v: str, doc: dict | None = None) -> str:
    config = (doc or rule_config(rule))["config"]
    if "cases" in config:
        whens = " ".join(f"WHEN {v} = '{c['value']}' THEN '{c['subRuleRef']}'" for c in config["cases"]["expressions"])
        return f"CASE {whens} ELSE '{config['cases']['alternative']['subRuleRef']}' END"
    whens = []
    for b in config["bands"]:
        tests = [f"{v} IS NOT NULL"]
        if "lowerLimit" in b:
            tests.append(f"{v} >= {b['lowerLimit']}")
        if "upperLimit" in b:
            tests.append(f"{v} < {b['upperLimit']}")
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{b['subRuleRef']}'")
    return f"CASE {' '.join(whens)} ELSE '.err' END"


def decided(rule: str, inner: str, doc: dict | None = None, ctes: str = "", value: bool = True) -> str:
    """``inner`` yields tenant_id, e2e, ok, v, x (exit or null)."""
    doc = doc or rule_config(rule)
    has_x00 = any(e["subRuleRef"] == ".x00" for e in doc["config"]["exitConditions"])
    x = "CASE WHEN NOT ok THEN '.x00' ELSE x END" if has_x00 else "x"
    shown = "NULL::DOUBLE" if "cases" in doc["config"] else "CASE WHEN x2 IS NULL THEN round(CAST(v AS DOUBLE), 6) END"
    v = "v" if "cases" in doc["config"] else "round(CAST(v AS DOUBLE), 6)"
    ctes = f", {ctes}" if ctes else ""
    return (f"WITH {PAY}{ctes}, s AS ({inner}), s2 AS (SELECT *, {x} AS x2 FROM s) "
            f"SELECT tenant_id, e2e, {shown} AS value, coalesce(x2, {band(rule, v, doc)}) AS sub_rule_ref FROM s2")


def haversine(lat1: str, lat2: str, lon1: str, lon2: str) -> str:
    return (f"(2 * 6371 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + pow(sin(radians({lon2} - {lon1}) / 2), 2)"
            f" * cos(radians({lat1})) * cos(radians({lat2})))))")

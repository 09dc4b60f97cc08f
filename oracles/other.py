"""Statements for everything but the numbered rules."""
from __future__ import annotations

from payscope.config.rules import FULL_SET, rule_config
from payscope.config.typologies import FULL_WEIGHTS
from payscope.plans.documents import MARKUP

from .base import PAY, band, haversine
from .rules import rule_sql, similar_sql

DAY = 86_400_000
JAN_15 = 1_705_276_800_000
E = "event_id"
CUT = f"({E} % 103 = 0 AND {E} > 0)"
NUM = f"(CASE WHEN {E} % 101 = 0 AND {E} > 0 THEN {E} - 1 ELSE {E} END)"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us({}) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z'"
WITH = f"WITH {PAY}"


def q(s: str) -> str:
    return s.replace("'", "''")


def _extract(mark: str, transfer: bool) -> str:
    at = f"ts - to_seconds({E} % 5)" if mark != "S" else "ts"
    hide = lambda x, n: f"CASE WHEN NOT {CUT} THEN {x} END AS {n}"
    cols = [f"{E} AS seq", hide(ISO.format(at, at), "cre_dt_tm"), hide(f"'{mark}' || {NUM}", "message_id"),
            hide(f"'E' || {E}", "end_to_end_id")]
    if transfer:
        cols += [hide("CAST(user_id AS VARCHAR)", "debtor_account_id"),
                 f"CASE WHEN NOT {CUT} AND ({E} % 97 <> 0 OR {E} = 0) THEN regexp_extract(props, '[0-9]+') END AS creditor_account_id"]
    cols += [hide("'tenant-00' || (1 + user_id % 2)", "tenant_id"), f"{CUT} AS malformed"]
    return f"SELECT {', '.join(cols)} FROM events"


EDGES = """subj AS (
  SELECT DISTINCT tenant_id, 'debtor' AS role, 'account' AS subject_type, dbtr_acct AS source FROM pay
  UNION SELECT DISTINCT tenant_id, 'creditor', 'account', cdtr_acct FROM pay
  UNION SELECT DISTINCT tenant_id, 'debtor', 'entity', dbtr_id FROM pay
  UNION SELECT DISTINCT tenant_id, 'creditor', 'entity', cdtr_id FROM pay),
edges AS (SELECT *, 'C-' || role || '-' || subject_type || '-' || source AS destination,
  1704412800000 + source * 3600000 AS incptn_ms,
  CASE WHEN source % 20 <> 0 THEN 1704412800000 + source * 3600000 + 604800000 END AS xprtn_ms,
  CASE (source // 10) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'override' WHEN 2 THEN 'overridable-block'
       ELSE 'non-overridable-block' END AS outcome FROM subj WHERE source % 10 = 0)"""
MATCHED = """matched AS (SELECT p.tenant_id, p.e2e, e.role, e.subject_type, e.destination, e.outcome FROM pay p JOIN edges e
  ON e.tenant_id = p.tenant_id AND e.incptn_ms <= p.t_ms AND (e.xprtn_ms IS NULL OR p.t_ms < e.xprtn_ms) AND
  e.source = CASE WHEN e.role = 'debtor' AND e.subject_type = 'account' THEN p.dbtr_acct
    WHEN e.role = 'creditor' AND e.subject_type = 'account' THEN p.cdtr_acct
    WHEN e.role = 'debtor' THEN p.dbtr_id ELSE p.cdtr_id END)"""
FLOW = """flow AS (SELECT p.tenant_id, p.e2e, CASE WHEN coalesce(bool_or(m.outcome = 'non-overridable-block'), false)
  THEN 'non-overridable-block' WHEN coalesce(bool_or(m.outcome = 'override'), false) THEN 'override'
  WHEN coalesce(bool_or(m.outcome = 'overridable-block'), false) THEN 'overridable-block' ELSE 'none' END AS outcome
  FROM pay p LEFT JOIN matched m USING (tenant_id, e2e) GROUP BY 1, 2)"""
ENDS = """ends AS (SELECT tenant_id, req_ms, dbtr_id AS entity, dbtr_acct AS account FROM pay
  UNION ALL SELECT tenant_id, req_ms, cdtr_id, cdtr_acct FROM pay),
entities AS (SELECT tenant_id, entity AS id, min(req_ms) AS cre_ms FROM ends GROUP BY 1, 2),
accounts AS (SELECT tenant_id, account AS id, min(req_ms) AS cre_ms FROM ends GROUP BY 1, 2),
holders AS (SELECT tenant_id, entity AS source, account AS destination, min(req_ms) AS cre_ms FROM ends GROUP BY 1, 2, 3),
tx AS (SELECT tenant_id, e2e AS end_to_end_id, dbtr_acct AS source, cdtr_acct AS destination,
    'pacs.008.001.10' AS tx_tp, req_ms AS cre_ms, amt, NULL AS tx_sts FROM pay
  UNION ALL SELECT tenant_id, e2e, cdtr_acct, dbtr_acct, 'pacs.002.001.12', t_ms, NULL,
    CASE WHEN ok THEN 'ACCC' ELSE 'RJCT' END FROM pay)"""
CONFIG = """conf AS (SELECT 'map-' || dbtr_acct AS id, '1.' || (dbtr_acct % 7) AS cfg, tenant_id,
  dbtr_acct % 50 = 0 AS active, CAST(min(t_ms) AS VARCHAR) AS cre_dt_tm,
  CASE WHEN max(t_ms) > min(t_ms) THEN CAST(max(t_ms) AS VARCHAR) END AS upd_dt_tm FROM pay GROUP BY tenant_id, dbtr_acct)"""


def _counts(hist: str = "pay", span: int | None = DAY) -> str:
    """Outcomes of rules 901 and 902, their scores and decisions in both public typologies."""
    def n(a, name):
        return (f"{name} AS (SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, count(p.e2e) AS v FROM {hist} q LEFT JOIN {hist} p "
                f"ON p.tenant_id = q.tenant_id AND p.ok AND p.{a} = q.{a} AND p.t_ms BETWEEN q.t_ms - {span} AND q.t_ms GROUP BY 1, 2)")
    ref = lambda r: f"CASE WHEN NOT ok THEN '.x00' ELSE {band(r, 'v')} END"
    weight = lambda c: f"CASE {c} WHEN '.x00' THEN 100 WHEN '.01' THEN 100 WHEN '.02' THEN 200 WHEN '.03' THEN 400 ELSE 0 END"
    return (f"{n('dbtr_acct', 'n901')}, {n('cdtr_acct', 'n902')}, "
            f"refs AS (SELECT tenant_id, e2e, '901' AS rule_id, v, {ref('901')} AS sub_rule_ref FROM n901 UNION ALL "
            f"SELECT tenant_id, e2e, '902', v, {ref('902')} FROM n902), "
            f"weighed AS (SELECT *, CAST({weight('sub_rule_ref')} AS DOUBLE) AS weight FROM refs), "
            "scores AS (SELECT tenant_id, e2e, '999-901@4.0.0' AS typology_cfg, weight AS score FROM weighed WHERE rule_id = '901' "
            "UNION ALL SELECT tenant_id, e2e, '999-901-902@4.0.0', sum(weight) FROM weighed GROUP BY 1, 2), "
            "decisions AS (SELECT *, score >= CASE typology_cfg WHEN '999-901@4.0.0' THEN 200 ELSE 300 END AS alert, "
            "score >= CASE typology_cfg WHEN '999-901@4.0.0' THEN 400 ELSE 500 END AS interdict FROM scores)")


STATUS = ("status AS (SELECT tenant_id, e2e, CASE WHEN bool_or(alert OR interdict) THEN 'ALRT' ELSE 'NALT' END AS status, "
          "bool_or(interdict) AS interdict, count(*) FILTER (WHERE alert) AS typologies_alerted FROM {} GROUP BY 1, 2)")
FLOWED = ("flowed AS (SELECT d.tenant_id, d.e2e, typology_cfg, score, alert, CASE WHEN outcome IN ('overridable-block', "
          "'non-overridable-block') THEN true WHEN outcome = 'override' THEN false ELSE interdict END AS interdict "
          "FROM decisions d JOIN flow USING (tenant_id, e2e))")
BATCH_PAY = f"""dd AS (SELECT event_id AS seq, {NUM} AS num, 'tenant-00' || (1 + user_id % 2) AS tenant_id, event_id AS e2e,
    user_id AS dbtr_acct, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS cdtr_acct, CAST(value AS DECIMAL(18,2)) AS amt,
    epoch_us(ts) // 1000 AS t_ms, epoch_us(ts) // 1000 - 1000 * (event_id % 5) AS req_ms, event_type <> 'error' AS ok FROM events WHERE NOT {CUT}),
  st AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY tenant_id, num ORDER BY t_ms, seq) = 1),
  tf AS (SELECT * FROM dd WHERE seq % 97 <> 0 OR seq = 0 QUALIFY row_number() OVER (PARTITION BY tenant_id, num ORDER BY req_ms, seq) = 1)"""
BOTH = (f"{BATCH_PAY}, bpay AS (SELECT st.tenant_id, 'E' || st.e2e AS e2e, tf.dbtr_acct, tf.cdtr_acct, st.t_ms, st.ok "
        "FROM st JOIN tf ON tf.tenant_id = st.tenant_id AND tf.e2e = st.e2e)")
LI = ("FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q0, CAST(l_linenumber AS BIGINT) AS q1, l_partkey % 10 AS q2 FROM lineitem)")
ARR = "[q0, q1, q2, q0 + 1]"
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _full_score() -> str:
    weights = {r: w for rules, w in FULL_WEIGHTS for r in rules}
    parts = []
    for r in FULL_SET:
        whens = " ".join(f"WHEN '{ref}' THEN {w}" for ref, w in weights[r].items())
        parts.append(f"SELECT tenant_id, e2e, CASE sub_rule_ref {whens} ELSE 0 END AS w FROM ({rule_sql(r)})")
    return f"SELECT tenant_id, e2e, CAST(sum(w) AS DOUBLE) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"


def _text() -> str:
    x = "html"
    for pattern, replacement in MARKUP:
        x = f"regexp_replace({x}, '{q(pattern)}', '{q(replacement)}', 'g')"
    return f"SELECT page_id, trim({x}) AS text FROM pages"


def _search(terms, k) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return (f"WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents), n AS (SELECT count(*) AS n, avg(len(words)) AS al FROM w), "
            f"tf AS (SELECT doc_id, len(any_value(words)) AS dl, t, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS t FROM w) "
            f"WHERE t IN ({listed}) GROUP BY doc_id, t), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t) "
            f"SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score "
            f"FROM tf JOIN df USING (t), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}")


def statements() -> dict[str, str]:
    s: dict[str, str] = {f"rule_{r}": rule_sql(r) for r in [*FULL_SET, "901", "902"]}
    s["rule_021_unbounded"] = similar_sql(None)
    s["event_flow"] = f"{WITH}, {EDGES}, {MATCHED}, {FLOW} SELECT * FROM flow"
    for name, mark in (("extract_pacs002", "S"), ("extract_pacs008", "T"), ("extract_pain001", "I"), ("extract_pain013", "A")):
        s[name] = _extract(mark, mark != "S")
    s["extract_transaction"] = (
        f"{WITH} SELECT 'E' || e2e AS end_to_end_id, CAST(amt AS DOUBLE) AS amt, ccy, 'T' || e2e AS msg_id, CAST(req_ms AS VARCHAR) AS cre_dt_tm, "
        "'pacs.008.001.10' AS tx_tp, NULL AS tx_sts, tenant_id FROM pay UNION ALL SELECT 'E' || e2e, NULL, ccy, 'S' || e2e, "
        "CAST(t_ms AS VARCHAR), 'pacs.002.001.12', CASE WHEN ok THEN 'ACCC' ELSE 'RJCT' END, tenant_id FROM pay")
    s["extract_condition"] = (f"{WITH}, {EDGES} SELECT destination AS cond_id, tenant_id, CAST(incptn_ms AS VARCHAR) AS cre_dt_tm, "
                              "CAST(xprtn_ms AS VARCHAR) AS upd_dt_tm FROM edges")
    s["extract_evaluation"] = f"{WITH} SELECT CAST(t_ms AS VARCHAR) AS cre_dt_tm, msg_id AS message_id, tenant_id FROM pay"
    s["extract_config"] = f"{WITH}, {CONFIG} SELECT * FROM conf"
    bad = f"CASE WHEN {CUT} THEN 'malformed document' WHEN {E} % 97 = 0 AND {E} > 0 THEN 'cdtr_acct_id_not_null' ELSE '' END"
    s["validate_message"] = f"SELECT {E} AS seq, {bad} = '' AS valid, {bad} AS errors FROM events"
    s["quarantine_sink"] = (
        f"SELECT CASE WHEN NOT {CUT} THEN 'T' || {NUM} END AS correlation_id, CASE WHEN {CUT} THEN 'DEFAULT' ELSE 'tenant-00' || "
        f"(1 + user_id % 2) END AS tenant_id, '/v1/evaluate/iso20022/pacs.008.001.10' AS endpoint_path, 'v1' AS version, {bad} AS error, "
        f"'quarantined' AS status FROM events WHERE {bad} <> ''")
    s["dedup_message"] = f"WITH {BATCH_PAY} SELECT tenant_id, 'S' || num AS message_id, 'E' || e2e AS end_to_end_id, seq FROM st"
    s["referential_check"] = (
        f"{WITH}, {ENDS} SELECT tenant_id, 'holder_source' AS \"constraint\", source AS missing FROM holders WHERE source % 17 = 3 UNION ALL "
        "SELECT tenant_id, 'holder_destination', destination FROM holders WHERE destination % 13 = 5 UNION ALL "
        "SELECT tenant_id, 'transaction_source', source FROM tx WHERE source % 13 = 5 UNION ALL "
        "SELECT tenant_id, 'transaction_destination', destination FROM tx WHERE destination % 13 = 5")
    s["map_payload"] = (
        f"{WITH} SELECT 'pacs.002.001.12' AS TxTp, 'M-' || e2e AS MsgId, CAST(e2e AS VARCHAR) AS EndToEndId, CAST(amt AS DOUBLE) AS Amt, "
        "'USD' AS Ccy, dbtr_acct AS source, cdtr_acct AS destination, CASE WHEN ok THEN 'ACCC' END AS TxSts FROM pay")
    s["map_payload_xml"] = (
        f"{WITH} SELECT CAST(e2e AS VARCHAR) AS EndToEndId, CAST(amt AS DOUBLE) AS Amt, 'USD' AS Ccy, dbtr_acct AS source, "
        "cdtr_acct AS destination, e2e || '/' || dbtr_acct AS MsgId FROM pay")
    s["ingest_pull"] = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL "
                        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
    s["ingest_push"] = ("SELECT c_custkey, c_name, 'customers' AS endpoint_path, 'v2' AS version FROM customer UNION ALL "
                        "SELECT c_custkey, c_name, 'customers', 'v1' FROM customer WHERE c_custkey % 2 = 0")
    data = ("'{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || "
            "'\",\"o_orderpriority\":\"' || o_orderpriority || '\"}'")
    s["enrich_rows"] = f"SELECT data, 'job-1' AS job_id, sha256(data) AS checksum FROM (SELECT {data} AS data FROM orders)"
    s["rotate_table"] = ("SELECT s_suppkey, upper(s_name) AS s_name, 'current' AS version FROM supplier UNION ALL "
                         "SELECT s_suppkey, s_name, 'backup' FROM supplier")
    s["job_history"] = (f"SELECT 'DEFAULT' AS tenant_id, 'job-1' AS job_id, count(*) AS counts, count(*) FILTER (WHERE {bad} = '') "
                        "AS processed_counts, CAST(NULL AS VARCHAR) AS exception, 'PULL' AS job_type FROM events")
    s["enrich_join"] = (f"{WITH} SELECT tenant_id, e2e, cdtr_acct, c_mktsegment FROM pay LEFT JOIN customer ON c_custkey = cdtr_acct")
    s["batch_take_on"] = (f"WITH {BOTH}, {_counts('bpay')} SELECT tenant_id, e2e, typology_cfg, score, alert, interdict FROM decisions")
    s["etl_extract"] = f"{WITH} SELECT tenant_id, e2e, t_ms, t_ms // {DAY} AS day FROM pay WHERE t_ms > {JAN_15}"
    s["lake_upsert"] = ("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, "
                        "CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS version, o_orderkey % 8 AS part FROM orders "
                        "WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
    counts, status, flow_status = _counts(), STATUS.format("decisions"), STATUS.format("flowed")
    base = f"{WITH}, {counts}"
    flowed = f"{base}, {EDGES}, {MATCHED}, {FLOW}, {FLOWED}"
    s["gold_transactions"] = (f"{base}, {status} SELECT p.tenant_id, t_ms // {DAY} AS day, p.e2e, dbtr_acct, cdtr_acct, "
                              "CAST(amt AS DOUBLE) AS amt, ok, status FROM pay p JOIN status USING (tenant_id, e2e)")
    s["evaluation_sink"] = (f"{base}, {status} SELECT p.tenant_id, t_ms // {DAY} AS day, msg_id, status, score AS first_score FROM pay p "
                            "JOIN status USING (tenant_id, e2e) JOIN (SELECT * FROM scores WHERE typology_cfg = '999-901-902@4.0.0') USING (tenant_id, e2e)")
    s["alert_sink"] = f"{flowed}, {flow_status} SELECT tenant_id, e2e, status, typologies_alerted FROM status WHERE status = 'ALRT'"
    s["interdiction_sink"] = f"{flowed} SELECT tenant_id, e2e, typology_cfg, score FROM flowed WHERE interdict"
    s["eventflow_sink"] = f"{WITH}, {EDGES}, {MATCHED}, {FLOW} SELECT * FROM flow WHERE outcome <> 'none'"
    s["doc_text_extract"] = _text()
    s["doc_index"] = (f"WITH p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2) "
                      "SELECT term, doc_id, tf, count(*) OVER (PARTITION BY term) AS df FROM p")
    s["doc_search"] = _search(["the", "with", "der", "que"], 20)
    s["active_network_map"] = (f"{WITH}, {CONFIG} SELECT tenant_id, cfg, count(*) OVER (PARTITION BY tenant_id) = 1 AS \"unique\" FROM conf WHERE active")
    s["settled_filter"] = (f"{WITH} SELECT tenant_id, e2e AS end_to_end_id, cdtr_acct AS source, dbtr_acct AS destination, t_ms AS cre_ms FROM pay WHERE ok")
    s["time_range_filter"] = f"{WITH} SELECT tenant_id, e2e, t_ms FROM pay WHERE t_ms BETWEEN {JAN_15 - 7 * DAY} AND {JAN_15}"
    s["distinct_e2e"] = f"{WITH} SELECT DISTINCT tenant_id, e2e AS end_to_end_id FROM pay"
    s["condition_updated"] = f"{WITH}, {EDGES} SELECT tenant_id, destination AS cond_id, xprtn_ms AS upd_ms FROM edges WHERE source % 20 <> 0"
    s["since_filter"] = f"{WITH}, {CONFIG} SELECT tenant_id, id, upd_dt_tm FROM conf WHERE CAST(upd_dt_tm AS BIGINT) >= {JAN_15 + 14 * DAY}"
    s["rule_status_filter"] = f"{WITH}, {CONFIG} SELECT id, cfg FROM conf WHERE active AND tenant_id = 'tenant-001' AND cfg >= '1.0'"
    s["settled_amounts"] = (f"{WITH} SELECT tenant_id, e2e AS end_to_end_id, dbtr_acct AS source, cdtr_acct AS destination, "
                            "CAST(amt AS DOUBLE) AS amt, req_ms AS cre_ms FROM pay WHERE ok")
    s["newest_first"] = f"{WITH} SELECT tenant_id, e2e AS end_to_end_id, req_ms AS cre_ms FROM pay WHERE ok ORDER BY 3 DESC, 2 DESC"
    held = "(SELECT tenant_id, destination AS a, min(source) AS h FROM holders GROUP BY 1, 2)"
    s["data_cache"] = (
        f"WITH {PAY}, {ENDS}, {BATCH_PAY} SELECT st.tenant_id, 'E' || st.e2e AS end_to_end_id, 'S' || st.num AS msg_id, hd.h AS dbtr_id, "
        "hc.h AS cdtr_id, CAST(tf.dbtr_acct AS VARCHAR) AS dbtr_acct_id, CAST(tf.cdtr_acct AS VARCHAR) AS cdtr_acct_id, "
        "CAST(tf.amt AS DOUBLE) AS instd_amt, CAST(tf.amt AS DOUBLE) AS intr_bk_sttlm_amt, CASE WHEN tf.seq IS NOT NULL THEN 1.0 END::DOUBLE AS xchg_rate, "
        "strftime(make_timestamp(st.t_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(st.t_ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS cre_dt_tm "
        f"FROM st LEFT JOIN tf ON tf.tenant_id = st.tenant_id AND tf.e2e = st.e2e LEFT JOIN {held} hd ON hd.tenant_id = st.tenant_id AND hd.a = tf.dbtr_acct "
        f"LEFT JOIN {held} hc ON hc.tenant_id = st.tenant_id AND hc.a = tf.cdtr_acct")
    s["rel_holder_entity"] = (f"{WITH}, {ENDS} SELECT h.tenant_id, source, destination, e.cre_ms AS entity_cre_ms FROM holders h "
                              "JOIN entities e ON e.tenant_id = h.tenant_id AND e.id = h.source")
    s["rel_holder_account"] = (f"{WITH}, {ENDS} SELECT h.tenant_id, source, destination, a.cre_ms AS account_cre_ms FROM holders h "
                               "JOIN accounts a ON a.tenant_id = h.tenant_id AND a.id = h.destination")
    s["rel_governed_subject"] = (
        f"{WITH}, {ENDS}, {EDGES} SELECT g.*, x.cre_ms AS subject_cre_ms FROM edges g JOIN (SELECT *, 'account' AS k FROM accounts UNION ALL "
        "SELECT *, 'entity' FROM entities) x ON x.tenant_id = g.tenant_id AND x.k = g.subject_type AND x.id = g.source")
    s["rel_governed_condition"] = f"{WITH}, {EDGES} SELECT tenant_id, role, subject_type, source, destination, outcome AS cond_tp FROM edges"
    s["rel_tx_destination"] = (f"{WITH}, {ENDS} SELECT t.tenant_id, end_to_end_id, tx_tp, destination, a.cre_ms AS account_cre_ms FROM tx t "
                               "JOIN accounts a ON a.tenant_id = t.tenant_id AND a.id = t.destination")
    for kind in ("entity", "account"):
        s[f"rel_{kind}_conditions"] = f"{WITH}, {EDGES} SELECT tenant_id, source, role, destination FROM edges WHERE subject_type = '{kind}'"
    s["rel_condition_subjects"] = f"{WITH}, {EDGES} SELECT tenant_id, destination, role, subject_type, source FROM edges"
    for end in ("out", "in"):
        s[f"rel_account_tx_{end}"] = f"{WITH}, {ENDS} SELECT tenant_id, source, destination, end_to_end_id, tx_tp FROM tx"
    s["condition_interval_join"] = f"{WITH}, {EDGES}, {MATCHED} SELECT * FROM matched"
    routed = ("routes AS (SELECT * FROM (VALUES ('EFRuP', 'none'), ('901', '4.0.0'), ('902', '4.0.0')) r(rule_id, rule_cfg))")
    s["route_event"] = f"{WITH}, {routed} SELECT tenant_id, e2e, '999@4.0.0' AS typology_cfg, rule_id, rule_cfg FROM pay, routes"
    s["resolve_rule_config"] = (
        f"{WITH}, {routed} SELECT tenant_id, rule_id, rule_cfg, CASE WHEN rule_id = 'EFRuP' THEN 0 ELSE count(*) END AS events, "
        "rule_id <> 'EFRuP' AS found FROM pay, routes GROUP BY 1, 2, 3")
    s["resolve_typology_config"] = (f"{WITH} SELECT tenant_id, e2e, '999@4.0.0' AS typology_cfg, 300 AS alert_threshold, 500 AS interdiction_threshold FROM pay")
    prior = ("prior AS (SELECT q.tenant_id, q.e2e, q.amt, p.e2e AS pe, p.amt AS pa, row_number() OVER (PARTITION BY q.tenant_id, q.e2e "
             "ORDER BY p.t_ms DESC, p.e2e DESC) AS rn FROM pay q LEFT JOIN pay p ON p.tenant_id = q.tenant_id AND p.ok AND p.dbtr_acct = q.dbtr_acct "
             "AND p.t_ms < q.t_ms WHERE q.ok)")
    s["count_matching"] = (f"{WITH}, {prior} SELECT tenant_id, e2e, 1 + count(*) FILTER (WHERE abs(CAST(pa AS DOUBLE) - CAST(amt AS DOUBLE)) <= "
                           "CAST(amt AS DOUBLE) * 0.25::DOUBLE) AS matching FROM prior WHERE rn <= 5 GROUP BY 1, 2")
    s["map_amounts"] = f"{WITH} SELECT tenant_id, e2e, CAST(amt AS DOUBLE) + 7 AS total, e2e % 5 = 0 AS mismatch FROM pay"
    s["population_stddev"] = (f"{WITH} SELECT tenant_id, dbtr_acct, round(coalesce(stddev_pop(CAST(amt AS DOUBLE)) FILTER (WHERE ok), 0), 6) AS sd FROM pay GROUP BY 1, 2")
    s["latest_n"] = (f"{WITH}, {prior} SELECT tenant_id, e2e, count(pe) AS n_recent, max(pe) FILTER (WHERE rn = 1) AS prev_1, "
                     "max(pe) FILTER (WHERE rn = 2) AS prev_2 FROM prior WHERE rn <= 2 GROUP BY 1, 2")
    s["typology_score"] = _full_score()
    s["rule_result_collect"] = (f"{base} SELECT tenant_id, e2e, '999@4.0.0' AS typology_cfg, string_agg(rule_id || sub_rule_ref, ',' ORDER BY rule_id) AS outcomes, "
                                "true AS complete FROM refs GROUP BY 1, 2")
    tot = "count(*) AS events, count(*) FILTER (WHERE ok) AS settled, CAST(sum(amt) AS DOUBLE) AS amount"
    s["tenant_rollup"] = f"{WITH} SELECT tenant_id, {tot} FROM pay GROUP BY 1 UNION ALL SELECT 'ALL', {tot} FROM pay"
    s["determine_outcome_band"] = ("SELECT CASE WHEN l_quantity < 10 THEN '.01' WHEN l_quantity < 40 THEN '.02' ELSE '.03' END AS ref, count(*) AS n, "
                                   "min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
    s["determine_outcome_case"] = ("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '.01' WHEN '2-HIGH' THEN '.02' ELSE '.00' END AS ref, count(*) AS n FROM orders GROUP BY 1")
    s["exit_condition"] = (f"SELECT tenant_id, e2e, sub_rule_ref, CASE sub_rule_ref WHEN '.x00' THEN 'Unsuccessful transaction' ELSE "
                           f"'Insufficient transaction history' END AS reason FROM ({rule_sql('021')}) WHERE sub_rule_ref LIKE '.x%'")
    young = "The debtor is younger than 18 years old"
    s["rule_err"] = (f"SELECT r.tenant_id, r.e2e, CASE WHEN user_id % 4 <> 0 THEN value END AS value, CASE WHEN user_id % 4 <> 0 THEN sub_rule_ref ELSE '.err' END "
                     f"AS sub_rule_ref, CASE WHEN user_id % 4 = 0 THEN 'Unhandled rule result outcome' WHEN sub_rule_ref = '.01' THEN '{young}' "
                     f"ELSE 'The debtor is 30 years or older' END AS reason FROM ({rule_sql('028')}) r JOIN (SELECT event_id, user_id FROM events) ON event_id = r.e2e")
    reasons = {b["subRuleRef"]: b["reason"] for b in rule_config("021")["config"]["bands"]}
    s["history_errors"] = (f"SELECT CASE sub_rule_ref WHEN '.x01' THEN '.err' ELSE sub_rule_ref END AS sub_rule_ref, CASE sub_rule_ref WHEN '.x01' THEN "
                           f"'Insufficient History and no exit condition in config' WHEN '.x00' THEN 'Unsuccessful transaction' WHEN '.01' THEN '{reasons['.01']}' "
                           f"ELSE '{reasons['.02']}' END AS reason, count(*) AS n FROM ({rule_sql('021')}) GROUP BY 1, 2")
    tolerance = "'Invalid config provided - tolerance parameter not provided or invalid type'"
    s["validate_rule_config"] = (
        "SELECT 'rule-' || p_partkey AS id, CASE p_partkey % 6 WHEN 1 THEN 'Invalid config provided - bands not provided' "
        "WHEN 2 THEN 'Invalid config provided - exitConditions not provided' "
        f"WHEN 3 THEN {tolerance} WHEN 4 THEN {tolerance} WHEN 5 THEN 'Invalid config provided - bands not provided' END AS error FROM part")
    s["rule_weight"] = f"{base} SELECT tenant_id, e2e, rule_id, sub_rule_ref, weight, false AS unknown_ref FROM weighed"
    s["typology_expression"] = f"{base} SELECT tenant_id, e2e, score FROM scores WHERE typology_cfg = '999-901-902@4.0.0'"
    s["typology_alert"] = f"{base} SELECT tenant_id, e2e, typology_cfg, score, alert FROM decisions"
    s["typology_interdict"] = f"{base} SELECT tenant_id, e2e, typology_cfg, score, interdict FROM decisions"
    s["flow_override"] = f"{flowed} SELECT * FROM flowed"
    s["adjudicate"] = f"{flowed}, {flow_status} SELECT * FROM status"
    s["evaluate_tenants"] = (f"{base} SELECT tenant_id, e2e, '999@4.0.0' AS typology_cfg, score, alert, interdict FROM decisions "
                             "WHERE typology_cfg = '999-901-902@4.0.0'")
    s["evaluation_report"] = (
        f"{base}, {status} SELECT d.tenant_id, d.e2e, 'S' || d.e2e AS msg_id, status, typology_cfg AS cfg, score, (SELECT string_agg(rule_id || sub_rule_ref, ',' ORDER BY rule_id) "
        "FROM refs r WHERE r.tenant_id = d.tenant_id AND r.e2e = d.e2e AND (d.typology_cfg <> '999-901@4.0.0' OR rule_id = '901')) AS rules "
        "FROM decisions d JOIN status USING (tenant_id, e2e)")
    matrix = " JOIN ".join(f"(SELECT tenant_id, e2e, sub_rule_ref AS r{r} FROM ({rule_sql(r)})) t{r}" + ("" if i == 0 else " USING (tenant_id, e2e)")
                           for i, r in enumerate(("044", "045", "091", "901", "902")))
    s["rule_hit_matrix"] = f"SELECT tenant_id, e2e, r044, r045, r091, r901, r902 FROM {matrix}"
    s["build_entities"] = f"{WITH}, {ENDS} SELECT * FROM entities"
    s["build_accounts"] = f"{WITH}, {ENDS} SELECT * FROM accounts"
    s["build_account_holders"] = f"{WITH}, {ENDS} SELECT * FROM holders"
    s["build_transactions"] = f"{WITH}, {ENDS} SELECT * REPLACE (CAST(amt AS DOUBLE) AS amt) FROM tx"
    s["insert_rows"] = (f"{WITH}, {ENDS} SELECT tenant_id, cdtr_acct AS id, min(req_ms) AS req_ms FROM pay WHERE cdtr_acct % 2 = 1 GROUP BY 1, 2")
    s["table_update"] = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"
    s["table_delete"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"
    s["table_select"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000"
    s["condition_admin"] = (f"{WITH}, {EDGES} SELECT * REPLACE (CASE WHEN source % 30 = 0 THEN {JAN_15} ELSE xprtn_ms END AS xprtn_ms) FROM edges UNION ALL "
                            "SELECT * REPLACE ('N' || destination AS destination) FROM edges WHERE source % 40 = 0")
    s["conditions_at"] = (f"{WITH}, {EDGES} SELECT tenant_id, role, subject_type, source, destination FROM edges WHERE incptn_ms <= {JAN_15} "
                          f"AND (xprtn_ms IS NULL OR {JAN_15} < xprtn_ms)")
    key = "l_orderkey, l_linenumber, l_shipdate"
    s["fn_math"] = (f"SELECT {key}, round(sqrt(l_extendedprice), 6) AS r_sqrt, abs(l_discount - 0.05::DOUBLE) AS r_abs, round(pow(l_quantity, 1.5), 6) AS r_pow, "
                    "round(sin(l_quantity), 6) AS r_sin, round(cos(l_quantity), 6) AS r_cos, round(asin(l_discount), 6) AS r_asin FROM lineitem")
    s["fn_string"] = ("SELECT page_id, len(string_split(url, '/')) AS parts, right(url, 5) AS tail, substring(url, 3, 5) AS mid, url AS trimmed, "
                      "substring(url, 5, 5) AS sub, upper(url) AS upper, lower(url) AS lower, CAST(page_id AS VARCHAR) AS text, length(url) AS size FROM pages")
    s["fn_array"] = (f"SELECT {key}, concat_ws(',', q0, q1, q2) AS popped, concat_ws(',', q0, q1, q2, q0 + 1, 9) AS pushed, concat_ws(',', q0 + 1, q2, q1, q0) AS reversed, "
                     "concat_ws(',', q0, q1, q2, q0 + 1, q0, q1, q2, q0 + 1) AS flat, concat_ws(',', q0, q1, q2, q0 + 1, q0, q1, q2, q0 + 1) AS joined, "
                     f"CASE WHEN q0 = q1 THEN 0 ELSE 1 END AS found, 4 AS size {LI}")
    s["fn_loop"] = (f"SELECT {key}, list_max([x * 2 FOR x IN {ARR}]) AS mapped, len([x FOR x IN {ARR} IF x > 5]) AS kept, list_min({ARR}) > 0 AS every_one, "
                    f"list_max({ARR}) > 40 AS any_one, CAST(list_sum({ARR}) AS BIGINT) AS total, ([x FOR x IN {ARR} IF x > 7])[1] AS first {LI}")
    s["fn_object"] = ("SELECT event_id, 'id,kind,user' AS keys, array_to_string(list_sort([CAST(user_id AS VARCHAR), 'K', CAST(event_id AS VARCHAR)]), ',') AS vals, "
                      "3 AS entries, true AS has_id, false AS left_has_id FROM events")
    s["fn_if"] = "SELECT CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS kind, count(*) AS n FROM lineitem GROUP BY 1"
    s["fn_ternary"] = ("SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'big closed' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'other' END AS kind, "
                       "count(*) AS n FROM orders GROUP BY 1")
    s["fn_stddev"] = f"SELECT {key}, l_partkey, round((SELECT stddev_pop(CAST(x AS DOUBLE)) FROM unnest({ARR}) u(x)), 6) AS sd {LI}"
    s["fn_haversine"] = f"{WITH} SELECT e2e, round({haversine('lat', '48.2', 'lon', '16.37')}, 6) AS km FROM pay"
    s["fn_sql"] = f"{WITH} SELECT cdtr_acct AS source, count(*) AS n FROM pay WHERE ok AND t_ms <= {JAN_15} GROUP BY 1"
    s["rule_plugin"] = (f"{WITH}, t AS (SELECT tenant_id, dbtr_acct, sum(amt) AS total FROM pay WHERE ok GROUP BY 1, 2), r AS (SELECT p.tenant_id, e2e, ok, "
                        "CASE WHEN ok AND total > 0 THEN round(CAST(amt AS DOUBLE) / CAST(total AS DOUBLE), 6) END AS v FROM pay p LEFT JOIN t USING (tenant_id, dbtr_acct)) "
                        "SELECT tenant_id, e2e, v AS value, CASE WHEN NOT ok THEN '.x00' WHEN v < 0.1 THEN '.01' WHEN v >= 0.1 THEN '.02' ELSE '.err' END AS sub_rule_ref FROM r")
    s["rule_backtest"] = (
        f"WITH {PAY}, {_counts()[:_counts().index(', n902')]}, wide AS (SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, count(p.e2e) AS v FROM pay q LEFT JOIN pay p "
        f"ON p.tenant_id = q.tenant_id AND p.ok AND p.dbtr_acct = q.dbtr_acct AND p.t_ms BETWEEN q.t_ms - {3 * DAY} AND q.t_ms GROUP BY 1, 2) "
        f"SELECT '901' AS rule_id, CASE WHEN NOT a.ok THEN '.x00' ELSE {band('901', 'a.v')} END AS old_ref, CASE WHEN NOT b.ok THEN '.x00' ELSE {band('901', 'b.v')} END AS new_ref, "
        f"count(*) AS events FROM n901 a JOIN wide b USING (tenant_id, e2e) GROUP BY 1, 2, 3 UNION ALL SELECT '045', sub_rule_ref, sub_rule_ref, count(*) FROM ({rule_sql('045')}) GROUP BY 2")
    s["rep_metrics"] = (f"{base}, {status} SELECT count(*) AS events, count(*) FILTER (WHERE status = 'ALRT') AS alerts, count(*) FILTER (WHERE interdict) AS interdictions, "
                        "round(count(*) FILTER (WHERE status = 'ALRT') / count(*), 6) AS alert_rate FROM status")
    day = f"(DATE '1970-01-01' + CAST(t_ms // {DAY} AS INTEGER))"
    s["rep_executive"] = (f"{WITH}, m AS (SELECT tenant_id, strftime({day}, '%Y-%m') AS month, count(*) AS events, sum(amt) AS a FROM pay GROUP BY 1, 2) "
                          "SELECT tenant_id, month, events, CAST(a AS DOUBLE) AS amount, round(CAST(a AS DOUBLE) / CAST(sum(a) OVER (PARTITION BY month) AS DOUBLE), 6) AS share FROM m")
    s["rep_fraud_trend"] = (f"{base}, {status}, d AS (SELECT p.tenant_id, CAST({day} AS VARCHAR) AS day, count(*) AS events, count(*) FILTER (WHERE status = 'ALRT') AS alerts "
                            "FROM pay p JOIN status USING (tenant_id, e2e) GROUP BY 1, 2) SELECT *, round(avg(alerts) OVER (PARTITION BY tenant_id ORDER BY CAST(day AS DATE) RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM d")
    s["rep_typology_effectiveness"] = (f"{base} SELECT typology_cfg, count(*) AS evaluated, count(*) FILTER (WHERE alert) AS breached, "
                                       "round(count(*) FILTER (WHERE alert) / count(*), 6) AS hit_rate, round(avg(score), 6) AS mean_score FROM decisions GROUP BY 1")
    three = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, sub_rule_ref FROM ({rule_sql(r)})" for r in ("901", "902", "044"))
    s["rep_rule_outcomes"] = f"SELECT rule_id, sub_rule_ref, count(*) AS events FROM ({three}) GROUP BY 1, 2"
    s["rep_case_trend"] = ("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS opened_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed_cases, "
                           "round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS closed_rate FROM orders GROUP BY 1")
    s["rep_case_tracking"] = ("SELECT priority, state, age_band, count(*) AS cases, round(avg(age), 6) AS mean_age, count(*) FILTER (WHERE age > 90) AS escalated FROM "
                              "(SELECT o_orderpriority AS priority, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'review' END AS state, "
                              "CASE WHEN age <= 30 THEN '0-30' WHEN age <= 90 THEN '31-90' ELSE '90+' END AS age_band, age FROM (SELECT *, "
                              "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS age FROM orders WHERE o_orderstatus <> 'F')) GROUP BY 1, 2, 3")
    s["rep_tms_performance"] = (f"{WITH} SELECT tenant_id, count(*) AS events, round(avg(t_ms - req_ms), 6) AS mean_ms, quantile_disc(t_ms - req_ms, 0.5) AS p50, "
                                "quantile_disc(t_ms - req_ms, 0.95) AS p95, quantile_disc(t_ms - req_ms, 0.99) AS p99 FROM pay GROUP BY 1")
    s["rep_tms_throughput"] = f"{WITH} SELECT tenant_id, t_ms // 60000 AS minute, count(*) AS events FROM pay GROUP BY 1, 2"
    edges = "SELECT tenant_id, dbtr_acct AS source, cdtr_acct AS destination, count(*) AS payments, CAST(sum(amt) AS DOUBLE) AS amount FROM pay GROUP BY 1, 2, 3"
    s["rep_account_network"] = f"{WITH} {edges}"
    s["rep_counterparty_network"] = (
        f"{WITH}, e AS ({edges}), two AS (SELECT a.tenant_id, a.source, count(*) AS n, sum(a.payments * b.payments) AS m FROM e a JOIN e b "
        "ON b.tenant_id = a.tenant_id AND b.source = a.destination GROUP BY 1, 2) SELECT e.tenant_id, e.source, count(*) AS payees, CAST(sum(payments) AS BIGINT) AS payments, "
        "coalesce(any_value(n), 0) AS two_step_paths, CAST(coalesce(any_value(m), 0) AS BIGINT) AS two_step_payments FROM e LEFT JOIN two USING (tenant_id, source) GROUP BY 1, 2")
    s["rep_alert_history"] = (f"{base}, {status}, a AS (SELECT p.tenant_id, dbtr_acct AS account, t_ms, e2e FROM pay p JOIN status USING (tenant_id, e2e) WHERE status = 'ALRT') "
                              "SELECT *, count(*) OVER (PARTITION BY tenant_id, account ORDER BY t_ms) AS alerts_so_far FROM a")
    s["rep_conditions_timeline"] = (
        f"{WITH}, {EDGES}, c AS (SELECT tenant_id, subject_type, incptn_ms AS t_ms, 1 AS a, 0 AS b FROM edges UNION ALL SELECT tenant_id, subject_type, xprtn_ms, 0, 1 "
        "FROM edges WHERE xprtn_ms IS NOT NULL), g AS (SELECT tenant_id, subject_type, t_ms, CAST(sum(a) AS BIGINT) AS started, CAST(sum(b) AS BIGINT) AS ended FROM c GROUP BY 1, 2, 3) "
        "SELECT *, CAST(sum(started - ended) OVER (PARTITION BY tenant_id, subject_type ORDER BY t_ms) AS BIGINT) AS in_force FROM g")
    def side(account: str, other: str, n: str) -> str:
        return (f"s_{n} AS (SELECT tenant_id, {account} AS account, count(DISTINCT {other}) AS degree_{n}, count(*) AS payments_{n}, "
                f"CAST(sum(amt) AS DOUBLE) AS flow_{n} FROM pay GROUP BY 1, 2)")
    cols = ", ".join(f"coalesce({c}_{n}, 0) AS {c}_{n}" for n in ("out", "in") for c in ("degree", "payments", "flow"))
    s["rep_transaction_graph"] = (
        f"{WITH}, {side('dbtr_acct', 'cdtr_acct', 'out')}, {side('cdtr_acct', 'dbtr_acct', 'in')} SELECT tenant_id, account, {cols}, "
        "round(coalesce(flow_in, 0) - coalesce(flow_out, 0), 2) AS flow_net FROM s_out FULL JOIN s_in USING (tenant_id, account)")
    s["stream_ingest"] = f"{WITH} SELECT tenant_id, e2e, t_ms, ok FROM pay"
    s["stream_dedup"] = "SELECT event_id, user_id, event_type FROM events"
    s["stream_pair"] = f"{WITH} SELECT tenant_id, e2e, CAST(amt AS DOUBLE) AS amt, ok FROM pay"
    s["stream_velocity"] = (f"{WITH} SELECT tenant_id, dbtr_acct, (t_ms // {DAY}) * {DAY} AS window_ms, count(*) AS payments FROM pay "
                            f"WHERE (t_ms // {DAY} + 1) * {DAY} <= (SELECT max(t_ms) FROM pay) - 3600000 GROUP BY 1, 2, 3")
    s["stream_rules"] = " UNION ALL ".join(f"SELECT tenant_id, e2e, '{r}' AS rule_id, value, sub_rule_ref FROM ({rule_sql(r)})" for r in [*FULL_SET, "901", "902"])
    s["stream_typology"] = f"{base} SELECT tenant_id, e2e, typology_cfg, score, alert, interdict FROM decisions"
    s["stream_alerts"] = f"{base}, {status} SELECT tenant_id, e2e, status FROM status WHERE status = 'ALRT'"
    half = 1_704_067_200_000 + 15 * DAY + 1
    s["stream_config_refresh"] = (
        f"{WITH}, n AS (SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, count(p.e2e) AS v FROM pay q LEFT JOIN pay p ON p.tenant_id = q.tenant_id AND p.ok AND "
        f"p.dbtr_acct = q.dbtr_acct AND p.t_ms BETWEEN q.t_ms - CASE WHEN q.t_ms < {half} THEN {DAY} ELSE {3 * DAY} END AND q.t_ms GROUP BY 1, 2) "
        f"SELECT tenant_id, e2e, CASE WHEN ok THEN CAST(v AS DOUBLE) END AS value, CASE WHEN NOT ok THEN '.x00' ELSE {band('901', 'v')} END AS sub_rule_ref FROM n")
    s["map_payload_functions"] = (
        f"{WITH} SELECT 'msg-' || e2e AS Reference, CAST(amt * 100 AS BIGINT) AS Cents, CAST(amt AS DOUBLE) + 0.25 AS Total, "
        "CASE WHEN ok THEN 'settled' ELSE 'open' END AS State, substr(tx_kind, 1, 3) AS Kind, CAST(cdtr_acct AS VARCHAR) AS Party FROM pay")
    s["batch_take_on_unmatched"] = (
        f"WITH {BATCH_PAY} SELECT tenant_id, 'E' || e2e AS end_to_end_id, 'S' || num AS message_id FROM st "
        "WHERE NOT EXISTS (SELECT 1 FROM tf WHERE tf.tenant_id = st.tenant_id AND tf.e2e = st.e2e)")
    later = lambda n: 1_705_276_800_000 + n * DAY
    s["resolve_rule_config_as_of"] = (
        f"{WITH}, v(tenant_id, since, name, days) AS (VALUES ('tenant-001', 0, 'a', 1), ('tenant-001', {later(0)}, 'b', 3), "
        f"('tenant-001', {later(7)}, 'c', 2), ('tenant-002', {later(-5)}, 'd', 1)) SELECT p.tenant_id, e2e, name, days "
        "FROM pay p LEFT JOIN v ON v.tenant_id = p.tenant_id AND v.since = (SELECT max(since) FROM v w WHERE w.tenant_id = p.tenant_id AND w.since <= p.t_ms)")
    s["rule_901_as_of"] = (
        f"{WITH}, n AS (SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, count(p.e2e) AS v FROM pay q LEFT JOIN pay p ON p.tenant_id = q.tenant_id AND p.ok AND "
        f"p.dbtr_acct = q.dbtr_acct AND p.t_ms BETWEEN q.t_ms - CASE WHEN q.t_ms < {later(0)} THEN {DAY} ELSE {3 * DAY} END AND q.t_ms GROUP BY 1, 2) "
        f"SELECT tenant_id, e2e, CASE WHEN ok THEN CAST(v AS DOUBLE) END AS value, CASE WHEN NOT ok THEN '.x00' ELSE {band('901', 'v')} END AS sub_rule_ref FROM n")
    s["typology_tenants"] = (
        f"{base}, t(typology_id, own) AS (VALUES ('typology-processor', true), ('typology-second', false)) "
        "SELECT tenant_id, e2e, typology_id, '999@4.0.0' AS typology_cfg, score * f AS score, score * f >= 300 AS alert, score * f >= 500 AS interdict "
        "FROM (SELECT *, CASE WHEN own AND tenant_id = 'tenant-001' THEN 3 ELSE 1 END AS f FROM scores, t WHERE typology_cfg = '999-901-902@4.0.0')")
    s["rep_counterparty_hops"] = (
        f"{WITH}, e AS (SELECT DISTINCT tenant_id, dbtr_acct AS a, cdtr_acct AS b FROM pay), one AS (SELECT * FROM e WHERE a <> b), "
        "two AS (SELECT DISTINCT x.tenant_id, x.a, y.b FROM one x JOIN e y ON y.tenant_id = x.tenant_id AND y.a = x.b WHERE y.b <> x.a "
        "AND NOT EXISTS (SELECT 1 FROM one o WHERE o.tenant_id = x.tenant_id AND o.a = x.a AND o.b = y.b)), "
        "g AS (SELECT DISTINCT tenant_id, dbtr_acct AS account, unnest([1, 2]) AS hop FROM pay) "
        "SELECT tenant_id, account, hop, CASE hop WHEN 1 THEN (SELECT count(*) FROM one o WHERE o.tenant_id = g.tenant_id AND o.a = g.account) "
        "ELSE (SELECT count(*) FROM two o WHERE o.tenant_id = g.tenant_id AND o.a = g.account) END AS counterparties FROM g")
    s["rep_case_lifecycle"] = (
        "WITH log AS (SELECT o_orderkey AS c, CAST(o_orderdate AS DATE) AS d, 0 AS seq, 'open' AS state FROM orders "
        "UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE), l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'escalated' WHEN l_returnflag = 'A' THEN 'open' "
        "WHEN l_linestatus = 'F' THEN 'closed' ELSE 'review' END FROM lineitem), days AS (SELECT c, d, max({'s': seq, 't': state}).t AS state FROM log GROUP BY 1, 2), "
        "r AS (SELECT *, lag(state) OVER w AS was, lead(d) OVER w - d AS days, lead(d) OVER w IS NULL AS final FROM days WINDOW w AS (PARTITION BY c ORDER BY d)) "
        "SELECT state, count(*) FILTER (WHERE was IS DISTINCT FROM state) AS stays, count(DISTINCT c) AS cases, "
        "count(*) FILTER (WHERE was = 'closed' AND state <> 'closed') AS from_closed, CAST(coalesce(sum(days), 0) AS BIGINT) AS days, "
        "count(*) FILTER (WHERE final) AS cases_now FROM r GROUP BY 1")
    return s

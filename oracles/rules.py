"""One statement per rule: each event is joined to the payments its definition names."""
from __future__ import annotations

from payscope.config.rules import rule_config

from .base import decided, haversine

X01 = "CASE WHEN {} THEN '.x01' END"


def per_event(select: str, on: str, other: str = "pay") -> str:
    return (f"SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, {select} FROM pay q LEFT JOIN {other} p "
            f"ON p.tenant_id = q.tenant_id AND p.ok AND {on} GROUP BY q.tenant_id, q.e2e")


def param(rule: str, name: str):
    return rule_config(rule)["config"]["parameters"][name]


def rule_sql(rule: str) -> str:
    out, into = "p.dbtr_acct = q.dbtr_acct", "p.cdtr_acct = q.cdtr_acct"
    day = "p.t_ms BETWEEN q.t_ms - 86400000 AND q.t_ms"
    prior, upto = "p.t_ms < q.t_ms", "p.t_ms <= q.t_ms"
    newest = "p.t_ms * 1000000 + p.e2e"
    none = X01.format("count(p.e2e) = 0")
    if rule == "001":
        return decided(rule, per_event(f"any_value(q.t_ms) - min(p.t_ms) AS v, {none} AS x",
                                       f"p.acct = q.cdtr_acct AND {prior}", "act"))
    if rule in ("003", "004"):
        side = "q.cdtr_acct" if rule == "003" else "q.dbtr_acct"
        return decided(rule, per_event(f"any_value(q.t_ms) - max(p.t_ms) AS v, {none} AS x",
                                       f"p.acct = {side} AND {prior}", "act"))
    if rule == "076":
        return decided(rule, per_event(f"any_value(q.t_ms) - max(p.t_ms) AS v, {none} AS x", f"{out} AND {prior}"))
    if rule in ("002", "016", "017"):
        who, on = {"002": ("p.dbtr_acct", "p.cdtr_acct = q.dbtr_acct"), "016": ("p.dbtr_acct", into),
                   "017": ("p.cdtr_acct", out)}[rule]
        r = param(rule, "maxQueryRange")
        return decided(rule, per_event(f"count(DISTINCT {who}) AS v, NULL AS x",
                                       f"{on} AND p.t_ms BETWEEN q.t_ms - {r} AND q.t_ms"))
    if rule in ("044", "045"):
        return decided(rule, per_event("count(p.e2e) AS v, NULL AS x", f"{out if rule == '044' else into} AND {upto}"))
    if rule in ("901", "902"):
        return decided(rule, per_event("count(p.e2e) AS v, NULL AS x", f"{out if rule == '901' else into} AND {day}"))
    if rule == "030":
        return decided(rule, per_event("count(p.e2e) AS v, NULL AS x", f"{out} AND {into} AND {upto}"))
    if rule == "007":
        return decided(rule, per_event(
            f"levenshtein(any_value(q.descr), arg_max(p.descr, {newest})) AS v, {none} AS x", f"{out} AND {prior}"))
    if rule == "074":
        km = haversine(f"arg_max(p.lat, {newest})", "any_value(q.lat)", f"arg_max(p.lon, {newest})", "any_value(q.lon)")
        return decided(rule, per_event(f"{km} / ((any_value(q.t_ms) - max(p.t_ms)) / 3600000.0) AS v, {none} AS x",
                                       f"{out} AND p.t_ms BETWEEN q.t_ms - 3600000 AND q.t_ms - 1"))
    if rule in ("020", "048"):
        inner = per_event(
            "count(p.e2e) AS n, avg(CAST(p.amt AS DOUBLE)) AS m, stddev_pop(CAST(p.amt AS DOUBLE)) AS sd, "
            "min(p.amt) AS lo, max(p.amt) AS hi, any_value(q.amt) AS a",
            f"{into if rule == '020' else out} AND {prior}")
        return decided(rule, "SELECT *, (CAST(a AS DOUBLE) - m) / sd AS v, CASE WHEN n = 0 THEN '.x01' "
                             "WHEN lo = hi AND a > hi THEN '.x03' WHEN lo = hi THEN '.x04' END AS x "
                             f"FROM ({inner})")
    if rule in ("054", "063"):
        digits = ", ".join(f"count(*) FILTER (WHERE d = '{d}') AS d{d}" for d in range(1, 10))
        chi = " + ".join(f"pow(d{d} - n * log10(1.0 + 1.0 / {d}), 2) / (n * log10(1.0 + 1.0 / {d}))"
                         for d in range(1, 10))
        side = out if rule == "054" else into
        inner = (f"SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, {digits} FROM pay q LEFT JOIN "
                 f"(SELECT *, regexp_extract(CAST(amt AS VARCHAR), '[1-9]') AS d FROM pay) p "
                 f"ON p.tenant_id = q.tenant_id AND p.ok AND {side} AND {upto} GROUP BY q.tenant_id, q.e2e")
        total = " + ".join(f"d{d}" for d in range(1, 10))
        return decided(rule, f"SELECT *, CASE WHEN n >= 50 THEN {chi} END AS v, "
                             f"{X01.format('n < 50')} AS x FROM (SELECT *, {total} AS n FROM ({inner}))")
    if rule in ("010", "011"):
        a = "dbtr_acct" if rule == "010" else "cdtr_acct"
        ctes = (f"bins AS (SELECT tenant_id, {a} AS acct, t_ms // 86400000 AS k, count(*) AS n FROM pay WHERE ok "
                f"GROUP BY ALL), hist AS (SELECT q.tenant_id, q.e2e, any_value(q.t_ms // 86400000) AS k, "
                f"min(b.k) AS k0, sum(b.n) AS s, sum(b.n * b.n) AS sq FROM pay q LEFT JOIN bins b "
                f"ON b.tenant_id = q.tenant_id AND b.acct = q.{a} AND b.k < q.t_ms // 86400000 GROUP BY 1, 2), "
                f"cur AS (SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, count(p.e2e) AS n0 FROM pay q "
                f"LEFT JOIN pay p ON p.tenant_id = q.tenant_id AND p.ok AND p.{a} = q.{a} AND p.t_ms <= q.t_ms "
                f"AND p.t_ms // 86400000 = q.t_ms // 86400000 GROUP BY 1, 2)")
        return decided(rule, "SELECT tenant_id, e2e, ok, (n0 - s / j) / sqrt(sq / j - (s / j) * (s / j)) AS v, "
                             "CASE WHEN j IS NULL OR j < 2 THEN '.x01' WHEN j * sq = s * s AND n0 * j > s THEN '.x03' "
                             "WHEN j * sq = s * s THEN '.x04' END AS x FROM (SELECT cur.*, CAST(k - k0 AS DOUBLE) AS j, "
                             "CAST(s AS DOUBLE) AS s, CAST(sq AS DOUBLE) AS sq FROM cur JOIN hist USING (tenant_id, e2e))",
                       ctes=ctes)
    if rule == "018":
        r = param(rule, "maxQueryRange")
        return decided(rule, per_event(
            "CAST(any_value(q.amt) AS DOUBLE) / CAST(max(p.amt) AS DOUBLE) AS v, "
            "CASE WHEN coalesce(max(p.amt), 0) <= 0 THEN '.x01' END AS x",
            f"{out} AND p.t_ms BETWEEN q.t_ms - {r} AND q.t_ms - 1"))
    if rule in ("006", "008"):
        test = "abs(p.amt - q.amt) <= 0.1 * q.amt" if rule == "006" else "p.cdtr_acct = q.cdtr_acct"
        inner = (f"SELECT q.tenant_id, q.e2e, q.ok, p.e2e AS pe, {test} AS hit, row_number() OVER (PARTITION BY "
                 f"q.tenant_id, q.e2e ORDER BY p.t_ms DESC, p.e2e DESC) AS rn FROM pay q LEFT JOIN pay p "
                 f"ON p.tenant_id = q.tenant_id AND p.ok AND {out} AND {prior}")
        return decided(rule, f"SELECT tenant_id, e2e, any_value(ok) AS ok, 1 + count(*) FILTER (WHERE hit) AS v, "
                             f"{X01.format('count(pe) = 0')} AS x FROM ({inner}) WHERE rn <= 2 GROUP BY 1, 2")
    if rule == "021":
        return similar_sql(86400000)
    if rule in ("024", "025", "026", "027"):
        own, other = ("cdtr_acct", "dbtr_acct") if rule in ("024", "026") else ("dbtr_acct", "cdtr_acct")
        goal = "q.amt * 0.9" if rule == "026" else "q.amt"
        got = "s * 0.9" if rule == "027" else "s"
        ctes = (f"run AS (SELECT q.tenant_id, q.e2e, q.ok, {goal} AS goal, m.e2e AS mc, sum(m.amt) OVER w AS s, "
                f"count(m.e2e) OVER w AS n FROM pay q LEFT JOIN pay m ON m.tenant_id = q.tenant_id AND m.ok "
                f"AND m.{other} = q.{own} AND m.t_ms BETWEEN q.t_ms - 86400000 AND q.t_ms WINDOW w AS (PARTITION BY "
                f"q.tenant_id, q.e2e ORDER BY m.t_ms DESC, m.e2e DESC))")
        return decided(rule, f"SELECT tenant_id, e2e, ok, v, CASE WHEN cnt = 0 THEN '.x01' WHEN v IS NULL THEN '.x03' "
                             f"END AS x FROM (SELECT tenant_id, e2e, any_value(ok) AS ok, count(mc) AS cnt, "
                             f"min(n) FILTER (WHERE abs({got} - goal) <= 0.1 * goal) AS v FROM run GROUP BY 1, 2)",
                       ctes=ctes)
    if rule == "028":
        return decided(rule, "SELECT tenant_id, e2e, ok, date_sub('year', birth_date, "
                             "CAST(make_timestamp(t_ms * 1000) AS DATE)) AS v, NULL AS x FROM pay")
    if rule == "075":
        near = haversine("p.lat", "q.lat", "p.lon", "q.lon")
        return decided(rule, per_event(f"count(*) FILTER (WHERE {near} <= 5.0) AS v, {none} AS x", f"{out} AND {prior}"))
    if rule == "078":
        return decided(rule, "SELECT tenant_id, e2e, ok, tx_kind AS v, NULL AS x FROM pay")
    if rule in ("083", "084"):
        who = "dbtr_id" if rule == "083" else "cdtr_id"
        ctes = ("held AS (SELECT tenant_id, dbtr_id AS entity, dbtr_acct AS acct, t_ms FROM pay "
                "UNION ALL SELECT tenant_id, cdtr_id, cdtr_acct, t_ms FROM pay)")
        return decided(rule, f"SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, count(DISTINCT h.acct) AS v, NULL AS x "
                             f"FROM pay q JOIN held h ON h.tenant_id = q.tenant_id AND h.entity = q.{who} "
                             f"AND h.t_ms <= q.t_ms GROUP BY q.tenant_id, q.e2e", ctes=ctes)
    if rule == "090":
        ctes = ("payers AS (SELECT DISTINCT q.tenant_id, q.e2e, q.t_ms, p.dbtr_acct AS payer FROM pay q JOIN pay p "
                "ON p.tenant_id = q.tenant_id AND p.ok AND p.cdtr_acct = q.dbtr_acct "
                "AND p.t_ms BETWEEN q.t_ms - 86400000 AND q.t_ms - 1), "
                "found AS (SELECT y.tenant_id, y.e2e, count(DISTINCT p.cdtr_acct) AS n FROM payers y JOIN pay p "
                "ON p.tenant_id = y.tenant_id AND p.ok AND p.dbtr_acct = y.payer "
                "AND p.t_ms BETWEEN y.t_ms - 86400000 AND y.t_ms - 1 GROUP BY 1, 2)")
        return decided(rule, "SELECT q.tenant_id, q.e2e, q.ok, coalesce(f.n, 0) AS v, NULL AS x FROM pay q "
                             "LEFT JOIN found f USING (tenant_id, e2e)", ctes=ctes)
    if rule == "091":
        return decided(rule, "SELECT tenant_id, e2e, ok, amt AS v, NULL AS x FROM pay")
    raise KeyError(rule)


def similar_sql(range_ms: int | None) -> str:
    span = "p.t_ms <= q.t_ms" + ("" if range_ms is None else f" AND p.t_ms >= q.t_ms - {range_ms}")
    inner = (f"SELECT q.tenant_id, q.e2e, any_value(q.ok) AS ok, list(p.amt) AS l, count(p.e2e) AS n, "
             f"arg_max(p.amt, p.req_ms * 1000000 + p.e2e) AS a0 FROM pay q LEFT JOIN pay p "
             f"ON p.tenant_id = q.tenant_id AND p.ok AND p.cdtr_acct = q.cdtr_acct AND {span} GROUP BY 1, 2")
    flat = f"SELECT tenant_id, e2e, ok, n, a0, unnest(l) AS a FROM ({inner})"
    return decided("021", f"SELECT tenant_id, e2e, any_value(ok) AS ok, count(*) FILTER (WHERE abs(a - a0) <= 0.1 * a0) "
                          f"AS v, CASE WHEN any_value(n) <= 1 THEN '.x01' END AS x FROM ({flat}) GROUP BY 1, 2")

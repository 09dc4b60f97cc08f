"""Dashboard reports over payments, decisions and cases. Metrics are ours; only the report names are given."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timeline import Measure, scan
from ..sources.shared import staged

DAY_MS, MINUTE_MS = 86_400_000, 60_000


def _day(ms: str = "t_ms"):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ms) / DAY_MS).cast("int"))


def metrics(status: DataFrame) -> DataFrame:
    alerts = F.count(F.when(F.col("status") == "ALRT", 1))
    return status.agg(F.count(F.lit(1)).alias("events"), alerts.alias("alerts"),
                      F.count(F.when(F.col("interdict"), 1)).alias("interdictions"),
                      F.round(alerts / F.count(F.lit(1)), 6).alias("alert_rate"))


def tenant_rollup(pay: DataFrame) -> DataFrame:
    """Counts per tenant and the grand total (tenant ``ALL``)."""
    rolled = pay.rollup("tenant_id").agg(F.grouping("tenant_id").alias("_all"), F.count(F.lit(1)).alias("events"),
                                         F.count(F.when(F.col("ok"), 1)).alias("settled"),
                                         F.sum("amt").cast("double").alias("amount"))
    return rolled.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("tenant_id")).alias("tenant_id"),
                         "events", "settled", "amount")


def executive(pay: DataFrame) -> DataFrame:
    """Totals per tenant and month with the tenant's share of the month."""
    rows = (pay.withColumn("month", F.date_format(_day(), "yyyy-MM")).groupBy("tenant_id", "month")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("amt").alias("_amt")))
    share = F.col("_amt") / F.sum("_amt").over(Window.partitionBy("month"))
    return rows.select("tenant_id", "month", "events", F.col("_amt").cast("double").alias("amount"),
                       F.round(share.cast("double"), 6).alias("share"))


def fraud_trend(pay: DataFrame, status: DataFrame) -> DataFrame:
    """Alerts per tenant and day with the mean of the listed days among the last seven."""
    daily = (pay.select("tenant_id", "e2e", _day().alias("day")).join(status, ["tenant_id", "e2e"])
             .groupBy("tenant_id", "day").agg(F.count(F.lit(1)).alias("events"),
                                              F.count(F.when(F.col("status") == "ALRT", 1)).alias("alerts")))
    week = Window.partitionBy("tenant_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select("tenant_id", F.col("day").cast("string").alias("day"), "events", "alerts",
                        F.round(F.avg("alerts").over(week), 6).alias("moving_avg"))


def typology_effectiveness(decisions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    hits = F.count(F.when(F.col("alert"), 1))
    return decisions.groupBy("typology_cfg").agg(
        n.alias("evaluated"), hits.alias("breached"), F.round(hits / n, 6).alias("hit_rate"),
        F.round(F.avg("score"), 6).alias("mean_score"))


def rule_outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("rule_id", "sub_rule_ref").agg(F.count(F.lit(1)).alias("events"))


def cases_from_orders(orders: DataFrame) -> DataFrame:
    """Case records over the orders table: status F closed, O open, P in review."""
    state = (F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open")
             .otherwise("review"))
    return orders.select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("opened"),
                         state.alias("state"), F.col("o_orderpriority").alias("priority"),
                         F.col("o_custkey").alias("subject"))


def case_trend(cases: DataFrame) -> DataFrame:
    closed = F.count(F.when(F.col("state") == "closed", 1))
    return cases.groupBy(F.date_format("opened", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("opened_cases"), closed.alias("closed_cases"),
        F.round(closed / F.count(F.lit(1)), 6).alias("closed_rate"))


def case_tracking(cases: DataFrame, today: str) -> DataFrame:
    """Unclosed cases by priority and age band; cases over 90 days count as escalated."""
    age = F.datediff(F.lit(today).cast("date"), F.col("opened"))
    band = F.when(age <= 30, "0-30").when(age <= 90, "31-90").otherwise("90+")
    return (cases.where(F.col("state") != "closed").groupBy("priority", "state", band.alias("age_band"))
            .agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(age), 6).alias("mean_age"),
                 F.count(F.when(age > 90, 1)).alias("escalated")))


def tms_throughput(pay: DataFrame) -> DataFrame:
    """Payments per tenant and minute."""
    return pay.groupBy("tenant_id", F.floor(F.col("t_ms") / MINUTE_MS).cast("bigint").alias("minute")).agg(
        F.count(F.lit(1)).alias("events"))


def tms_performance(pay: DataFrame) -> DataFrame:
    """Latency (transfer to status, ms) per tenant: mean and nearest-rank p50, p95, p99.

    Exact percentiles over counts per distinct latency, so the ranked window sees distinct values, not payments.
    """
    counts = (pay.select("tenant_id", (F.col("t_ms") - F.col("req_ms")).alias("ms"))
              .groupBy("tenant_id", "ms").agg(F.count(F.lit(1)).alias("n")))
    ordered = Window.partitionBy("tenant_id").orderBy("ms")
    ranked = counts.select("tenant_id", "ms", "n", F.sum("n").over(ordered).alias("upto"),
                           F.sum("n").over(Window.partitionBy("tenant_id")).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p / 100), F.col("ms")))
    return ranked.groupBy("tenant_id").agg(
        F.sum("n").alias("events"), F.round(F.sum(F.col("ms") * F.col("n")) / F.sum("n"), 6).alias("mean_ms"),
        at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


def account_network(pay: DataFrame) -> DataFrame:
    return pay.groupBy("tenant_id", F.col("dbtr_acct").alias("source"), F.col("cdtr_acct").alias("destination")).agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amt").cast("double").alias("amount"))


def counterparty_network(pay: DataFrame) -> DataFrame:
    """Per account: direct payees, payments to them, and two-step paths that begin with it.

    Two-step reach is counted from the payees' degrees instead of listing pairs, so a hub costs one row per edge.
    """
    edges = account_network(pay)
    degree = edges.groupBy("tenant_id", F.col("source").alias("destination")).agg(
        F.count(F.lit(1)).alias("next_payees"), F.sum("payments").alias("next_payments"))
    return (edges.join(degree, ["tenant_id", "destination"], "left").groupBy("tenant_id", "source")
            .agg(F.count(F.lit(1)).alias("payees"), F.sum("payments").alias("payments"),
                 F.coalesce(F.sum("next_payees"), F.lit(0)).alias("two_step_paths"),
                 F.coalesce(F.sum(F.col("payments") * F.col("next_payments")), F.lit(0)).alias("two_step_payments")))


def counterparties(pay: DataFrame, accounts: DataFrame, hops: int = 2) -> DataFrame:
    """For given accounts (tenant_id, account): how many distinct accounts payments lead to in exactly so many steps.

    Each step goes on from the accounts reached in the step before, each once for a given account, and leaves out those
    reached already, the given one included. Work grows with what the given accounts reach.
    """
    edges = staged(pay.select("tenant_id", F.col("dbtr_acct").alias("node"), F.col("cdtr_acct").alias("next"))
                   .where("node is not null and next is not null").distinct(), "edges")
    given = accounts.select("tenant_id", "account").distinct()
    seen = given.withColumns({"node": F.col("account"), "hop": F.lit(0)})
    for hop in range(1, hops + 1):
        step = (seen.where(F.col("hop") == hop - 1).join(edges, ["tenant_id", "node"])
                .select("tenant_id", "account", F.col("next").alias("node")).distinct()
                .join(seen.select("tenant_id", "account", "node"), ["tenant_id", "account", "node"], "left_anti"))
        seen = staged(seen.unionByName(step.withColumn("hop", F.lit(hop))), "reached")
    wanted = given.withColumn("hop", F.explode(F.sequence(F.lit(1), F.lit(hops))))
    found = seen.where("hop > 0").groupBy("tenant_id", "account", "hop").agg(F.count(F.lit(1)).alias("counterparties"))
    return wanted.join(found, ["tenant_id", "account", "hop"], "left").na.fill({"counterparties": 0})


SKETCH = 10  # lgConfigK of the sketches: 1024 registers, a standard error near 3 %


def counterparties_sketched(pay: DataFrame) -> DataFrame:
    """For every account: estimates of the distinct accounts that payments lead to in one step, and in one or two.

    A sketch for each account is sent along each edge once and merged by aggregation, so the work grows with the edges,
    not with what is reached; the account itself counts where payments lead back.
    """
    edges = staged(pay.select("tenant_id", F.col("dbtr_acct").alias("account"), F.col("cdtr_acct").alias("next"))
                   .where("account is not null and next is not null").distinct(), "edges")
    near = staged(edges.groupBy("tenant_id", "account").agg(F.hll_sketch_agg("next", F.lit(SKETCH)).alias("one")), "sketches")
    beyond = (edges.join(near.select("tenant_id", F.col("account").alias("next"), "one"), ["tenant_id", "next"])
              .groupBy("tenant_id", "account").agg(F.hll_union_agg("one").alias("two")))
    both = near.join(beyond, ["tenant_id", "account"], "left")
    return both.select("tenant_id", "account", F.hll_sketch_estimate("one").alias("one_step"), F.hll_sketch_estimate(
        F.coalesce(F.hll_union("one", "two"), "one")).alias("two_steps"))


def case_events(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """A log of case events over orders and their lines: opened with the order; each line shipped escalates it (returned),
    reopens it (accepted), closes it (done) or puts it under review. ``seq`` orders events of one day."""
    opened = orders.select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("day"), F.lit(0).alias("seq"),
                           F.lit("open").alias("state"))
    state = (F.when(F.col("l_returnflag") == "R", "escalated").when(F.col("l_returnflag") == "A", "open")
             .when(F.col("l_linestatus") == "F", "closed").otherwise("review"))
    return opened.unionByName(lines.select(F.col("l_orderkey").alias("case_id"), F.to_date("l_shipdate").alias("day"),
                                           F.col("l_linenumber").cast("int").alias("seq"), state.alias("state")))


def case_lifecycle(log: DataFrame) -> DataFrame:
    """Per state: stays in it, cases that were in it, days spent in it, cases now in it, and returns to it from closed.

    A stay is a run of equal states. Of the events of one day the last one counts (of equal ``seq`` the greatest state). What was before comes from the time
    line of the case, so one case may hold most of the log; the last stay of a case has no length yet.
    """
    days = (log.where("case_id is not null and day is not null")
            .groupBy("case_id", (F.unix_date("day").cast("bigint") * DAY_MS).alias("t_ms"))
            .agg(F.max(F.struct("seq", "state"))["state"].alias("state")))
    days = staged(days, "case-days")
    at = F.struct("t_ms", "state").alias("last")
    line = scan(days.select("case_id", "t_ms", F.lit(True).alias("real"), at), ["case_id"], "t_ms",
                [Measure("last", "max", here=True)], block_ms=64 * DAY_MS)
    # a few rows, one for each pair of states that follow each other, hold all that is counted over moments
    known = line.select(F.col("last_here.state").alias("state"), F.col("last.state").alias("was"),
                        ((F.col("t_ms") - F.col("last.t_ms")) / DAY_MS).cast("bigint").alias("days"))
    steps = known.groupBy("state", "was").agg(F.count(F.lit(1)).alias("n"), F.sum("days").alias("days"))
    begins = F.col("was").isNull() | (F.col("was") != F.col("state"))
    by_case = days.groupBy("case_id").agg(F.collect_set("state").alias("states"), F.max_by("state", "t_ms").alias("now"))
    cases = by_case.select("now", F.explode("states").alias("state")).groupBy("state").agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("now") == F.col("state"), 1)).alias("cases_now"))
    moves = steps.select(F.inline(F.array(
        F.struct("state", F.when(begins, F.col("n")).alias("stays"), F.when(begins & (F.col("was") == "closed"), F.col("n"))
                 .alias("from_closed"), F.lit(None).cast("bigint").alias("days")),
        F.struct(F.col("was").alias("state"), F.lit(None).cast("bigint").alias("stays"),
                 F.lit(None).cast("bigint").alias("from_closed"), "days"))))
    counts = moves.groupBy("state").agg(*[F.sum(c).alias(c) for c in ("stays", "from_closed", "days")])
    return cases.join(counts, "state").select("state", "stays", "cases", "from_closed", "days", "cases_now").na.fill(0)


def transaction_graph(pay: DataFrame) -> DataFrame:
    """Degree, weighted degree and flow per account."""
    edges = pay.groupBy("tenant_id", "dbtr_acct", "cdtr_acct").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amt").alias("amt"))

    def side(account: str, name: str) -> DataFrame:
        return edges.groupBy("tenant_id", F.col(account).alias("account")).agg(
            F.count(F.lit(1)).alias(f"degree_{name}"), F.sum("n").alias(f"payments_{name}"),
            F.sum("amt").cast("double").alias(f"flow_{name}"))

    joined = side("dbtr_acct", "out").join(side("cdtr_acct", "in"), ["tenant_id", "account"], "full_outer")
    filled = joined.na.fill(0)
    return filled.withColumn("flow_net", F.round(F.col("flow_in") - F.col("flow_out"), 2))


def alert_history(pay: DataFrame, status: DataFrame) -> DataFrame:
    """Alerted payments per debtor account in time order with the account's alerts so far."""
    alerts = staged(pay.select("tenant_id", "e2e", "t_ms", F.col("dbtr_acct").alias("account"))
                    .join(status.where(F.col("status") == "ALRT").select("tenant_id", "e2e"), ["tenant_id", "e2e"]), "alerts")
    rows = alerts.select("tenant_id", "account", "t_ms", F.lit(True).alias("real"), F.lit(1).cast("bigint").alias("alerts_so_far"))
    return alerts.join(scan(rows, ["tenant_id", "account"], "t_ms", [Measure("alerts_so_far")]),
                       ["tenant_id", "account", "t_ms"])


def conditions_timeline(edges: DataFrame) -> DataFrame:
    """Condition starts and ends per tenant and subject type with the number then in force."""
    def step(at, started, ended):
        return F.struct(at.alias("t_ms"), F.lit(started).cast("bigint").alias("started"),
                        F.lit(ended).cast("bigint").alias("ended"))
    steps = (edges.select("tenant_id", "subject_type", F.inline(F.array(
        step(F.col("incptn_ms"), 1, 0), step(F.col("xprtn_ms"), 0, 1)))).where("t_ms is not null")
        .withColumns({"real": F.lit(True), "in_force": F.col("started") - F.col("ended")}))
    line = scan(steps, ["tenant_id", "subject_type"], "t_ms",
                [Measure("in_force"), Measure("started", here=True), Measure("ended", here=True)])
    return line.select("tenant_id", "subject_type", "t_ms", F.col("started_here").alias("started"),
                       F.col("ended_here").alias("ended"), "in_force")

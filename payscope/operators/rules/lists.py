"""Rules over several payments at once: last-N similarity, largest so far, similar amounts, mirroring.

Limits, exits and texts are configuration; rule 021 follows the published rule logic, the others are our
definitions (see each function).
"""
from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...sources.shared import staged
from ..outcome import NO_HISTORY, NO_X00, NOT_NUMERIC, outcome, results
from ..timeline import Measure, last_up_to, range_max, recent, scan
from .account import fresh

if TYPE_CHECKING:
    from ..kept import Kept

CENTS = 100
MOST_CENTS = 10 ** 18 - 1  # the largest decimal(18,2) amount
BASE = 8  # an amount cell has so many cells of the next lower level
MAX_LEVEL = next(j for j in range(64) if BASE ** j > MOST_CENTS)  # one cell of this level holds every amount


def _dec(x: float | int) -> Column:
    d = Decimal(str(x))
    digits = len(d.as_tuple().digits)
    scale = max(0, -d.as_tuple().exponent)
    return F.lit(d).cast(f"decimal({max(digits, scale + 1)},{scale})")


def last_n(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    """Rules 006 and 008 over the current payment and the N-1 latest settled prior ones of the debtor account.

    006 counts amounts within tolerance of the current amount, 008 payments to the current creditor account; the
    current payment counts itself. No prior payment: ``.x01``.
    """
    size = max(int(d["config"]["parameters"]["maxQueryLimit"]) for d in docs.values()) - 1
    columns = ["tenant_id", "dbtr_acct", "t_ms", F.struct("t_ms", "e2e", "amt", "cdtr_acct").alias("item")]
    settled = pay.where(F.col("ok") & fresh(kept)).select(*columns)
    if kept is not None:
        settled = settled.unionByName(kept.latest.select(*columns))
    tail = recent(settled, ["tenant_id", "dbtr_acct"], "t_ms", "item", size)
    wide = pay.join(tail, ["tenant_id", "dbtr_acct", "t_ms"], "left")
    outs = []
    for rule, doc in docs.items():
        params = doc["config"]["parameters"]
        items = F.slice("recent", 1, int(params["maxQueryLimit"]) - 1)
        if rule == "006":
            near = lambda i: F.abs(i["amt"] - F.col("amt")) <= _dec(params["tolerance"]) * F.col("amt")
        else:
            near = lambda i: i["cdtr_acct"] == F.col("cdtr_acct")
        value = F.size(F.filter(items, near)) + 1
        outs.append(outcome(doc, F.when(F.size("recent") > 0, value),
                            F.when(F.col("dbtr_acct").isNotNull() & (F.coalesce(F.size("recent"), F.lit(0)) < 1), ".x01")))
    return results(wide, outs)


def largest(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    """Rule 018: amount over the largest settled prior outgoing amount in range; none (or only zeros): ``.x01``."""
    doc = docs["018"]
    rows = pay.select("tenant_id", "dbtr_acct", "t_ms", F.lit(True).alias("real"),
                      F.when(F.col("ok"), F.col("amt")).alias("top"))
    if kept is not None:
        rows = rows.unionByName(kept.tops.select("tenant_id", "dbtr_acct", "t_ms", F.lit(False).alias("real"), "top"))
    tops = range_max(rows, ["tenant_id", "dbtr_acct"], "t_ms", "top", doc["config"]["parameters"]["maxQueryRange"],
                     include_now=False)
    wide = pay.join(tops, ["tenant_id", "dbtr_acct", "t_ms"], "left")
    some = F.coalesce(F.col("top") > 0, F.lit(False))
    value = F.when(some, F.col("amt").cast("double") / F.col("top").cast("double"))
    return results(wide, [outcome(doc, value, F.when(F.col("dbtr_acct").isNotNull() & ~some, ".x01"))])


def _div(x: Column, width: Column | int) -> Column:
    """Whole division that rounds down, also below zero."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.call_function("div", x - F.pmod(x, width), width)


def _width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), 3 * level)


def _level_of(span: Column) -> Column:
    """The highest level whose cells, of ``BASE`` ** level cents, are no wider than so many cents."""
    return F.least(F.lit(MAX_LEVEL), F.floor(F.log2(F.greatest(span, F.lit(1.0))) / 3 + 1e-9).cast("int"))


def _amount_runs(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """``rows`` with the aligned cells that exactly tile the integer interval [low, high], in runs: (level, parent, first,
    behind) stands for the cells first <= i < behind of the ``BASE`` ones in a parent cell. Each level has at most two
    runs, which are worked out in plain columns, a level a row: array functions cost ten times as much here."""
    kept = rows.columns
    ends = rows.select(*kept, low.alias("_low"), high.alias("_high"))
    levels = ends.select(*kept, "_low", "_high", F.explode(F.sequence(
        F.lit(0), _level_of((F.col("_high") - F.col("_low") + 2).cast("double")))).alias("level"))
    wide = levels.withColumn("_width", _width(F.col("level")))
    cells = wide.select(*kept, "level", _div(F.col("_low") + (F.col("_width") - 1), F.col("_width")).alias("_lo"),
                        _div(F.col("_high") + 1, F.col("_width")).alias("_hi")).where("_lo < _hi")
    inner = cells.select("*", (_div(F.col("_lo") + (BASE - 1), BASE) * BASE).alias("_lo_up"),
                         (_div(F.col("_hi"), BASE) * BASE).alias("_hi_up"))
    runs = inner.select(*kept, "level", F.inline(F.array(
        F.struct(F.col("_lo").alias("_a"), F.least("_hi", "_lo_up").alias("_b")),
        F.struct(F.greatest("_lo_up", "_hi_up").alias("_a"), F.col("_hi").alias("_b"))))).where("_a < _b")
    placed = runs.withColumn("parent", _div(F.col("_a"), BASE))
    return placed.select(*kept, "level", "parent", (F.col("_a") - F.col("parent") * BASE).cast("int").alias("first"),
                         (F.col("_b") - F.col("parent") * BASE).cast("int").alias("behind"))


def _similar(rows: DataFrame, tolerance: float, range_ms: int | None) -> DataFrame:
    """Rule 021 statistics without listing payments: ``n`` settled payments in range, ``bad`` ones without an amount,
    ``similar`` ones with an amount within tolerance of the newest.

    The newest amount comes from a blocked range maximum. Counting payments with an amount in [low, high] and a time
    in range becomes sums of running counts: a payment is counted once per level of amount cells, under its parent cell and
    its place there, and a question reads at most two runs of places per level, so the work is rows x log(amount), however
    busy the account.
    """
    keys = ["tenant_id", "acct"]
    newest = rows.withColumn("newest", F.struct("req_ms", "e2e", "amt"))
    if range_ms is None:
        top = scan(newest, keys, "t_ms", [Measure("newest", "max")])
        now = newest.groupBy(*keys, "t_ms").agg(F.max("newest").alias("_now"))
        top = top.join(now, [*keys, "t_ms"]).withColumn("newest", F.greatest("newest", "_now")).drop("_now")
    else:
        top = range_max(newest, keys, "t_ms", "newest", range_ms, include_now=True)
    one = F.lit(1).cast("bigint")
    total = scan(rows.withColumns({"n": one, "bad": F.when(F.col("amt").isNull(), one)}), keys, "t_ms",
                 [Measure("n", range_ms=range_ms), Measure("bad", range_ms=range_ms)])
    asked = top.join(total, [*keys, "t_ms"]).select(*keys, "t_ms", F.col("newest.amt").alias("a0"), "n", "bad")

    slack = F.col("a0") * _dec(tolerance)
    low = F.ceil(F.greatest((F.col("a0") - slack) * CENTS, F.lit(-MOST_CENTS))).cast("bigint")
    high = F.floor(F.least((F.col("a0") + slack) * CENTS, F.lit(MOST_CENTS))).cast("bigint")
    asks = _amount_runs(asked.where("n > 1 and bad = 0").select(*keys, "t_ms", "a0"), low, high)
    asks = asks.drop("a0").withColumn("real", F.lit(True))
    cents = (F.col("amt") * CENTS).cast("bigint")
    widest = (F.lit(MAX_LEVEL) if tolerance >= 0.99 else
              _level_of(cents * (2.0 * tolerance / (1.0 - tolerance)) + 4.0))
    points = rows.where("amt is not null").select(*keys, "t_ms", F.explode(F.sequence(F.lit(0), widest)).alias("level"),
                                                  cents.alias("_c"))
    cell = _div(F.col("_c"), _width(F.col("level")))
    points = points.select(*keys, "t_ms", "level", cell.alias("_c")).select(
        *keys, "t_ms", "level", _div(F.col("_c"), BASE).alias("parent"), F.pmod("_c", F.lit(BASE)).alias("_place"))
    places = [f"at_{i}" for i in range(BASE)]
    points = points.select(*keys, "t_ms", "level", "parent", F.lit(False).alias("real"),
                           *[F.when(F.col("_place") == i, one).alias(c) for i, c in enumerate(places)])
    counted = scan(points.unionByName(asks, allowMissingColumns=True), [*keys, "level", "parent"], "t_ms",
                   [Measure(c, range_ms=range_ms) for c in places], along=["first", "behind"])
    inside = [F.when((F.col("first") <= i) & (F.col("behind") > i), F.col(c)).otherwise(0) for i, c in enumerate(places)]
    counted = counted.select(*keys, "t_ms", reduce(Column.__add__, inside).alias("n"))
    matches = counted.groupBy(*keys, "t_ms").agg(F.sum("n").alias("similar"))
    return asked.join(matches, [*keys, "t_ms"], "left").select(*keys, "t_ms", "n", "bad", "similar")


def similar_amounts(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame:
    """Rule 021: settled payments into the creditor account in range with an amount within tolerance of the newest.

    The newest is the last by transfer time (ties: e2e), the range runs over status time. Without ``.x00`` in the
    configuration an unsettled payment ends in its error before any history is read; a payment in range without an
    amount (its document held no number) is a type mismatch.
    """
    doc = docs["021"]
    params = doc["config"]["parameters"]
    rows = pay.where("ok").select("tenant_id", F.col("cdtr_acct").alias("acct"), "t_ms", "req_ms", "e2e", "amt",
                                  F.lit(True).alias("real"))
    found = _similar(rows, params["tolerance"], params.get("maxQueryRange") or None)
    wide = pay.withColumnRenamed("cdtr_acct", "acct").join(found, ["tenant_id", "acct", "t_ms"], "left")
    error = (F.when(~F.col("ok"), F.lit(NO_X00)).when(F.col("n").isNull(), F.lit(NO_HISTORY))
             .when(F.col("bad") > 0, F.lit(NOT_NUMERIC)))
    return results(wide, [outcome(doc, F.when(F.col("n") > 1, F.col("similar")), F.when(F.col("n") <= 1, ".x01"), error)])


def _mirror(pay: DataFrame, docs: Mapping[str, dict], own: str, other: str) -> DataFrame:
    """Mirroring for one side: does the account's opposite flow, newest first, add up to the current amount?

    Value: the least number n of newest opposite payments in range whose sum is within tolerance of the target.
    Payments are ordered by (t_ms, e2e) and those up to the current millisecond take part; amounts are not negative.
    No opposite flow: ``.x01``, no match ``.x03``. Sums only grow with n, so the match is found by looking up one position
    in the running sum: questions and payments are sorted by it in ranges of about equal rows, whatever their account or
    hour, and the last payment up to a question answers it. A payment before the range is no match.
    """
    keys = ["tenant_id", "acct"]
    first = next(iter(docs.values()))["config"]["parameters"]
    range_ms = int(first["maxQueryRange"])
    money = "decimal(28,2)"

    ask_cells = F.struct(F.col(own).alias("acct"), F.col("t_ms").alias("t_ms"), F.lit(True).alias("real"),
                         F.lit(None).cast(money).alias("c"), F.lit(None).cast("bigint").alias("n"),
                         F.lit(None).cast("bigint").alias("n_in"))
    flow_cells = F.struct(F.col(other).alias("acct"), F.col("t_ms").alias("t_ms"), F.lit(True).alias("real"),
                          F.col("amt").cast(money).alias("c"), F.lit(1).cast("bigint").alias("n"),
                          F.lit(1).cast("bigint").alias("n_in"))
    settled = pay.where("ok")
    # read three times, each time by other columns, which Spark would scan anew
    line = staged(scan(settled.select("tenant_id", F.inline(F.array(ask_cells, flow_cells))), keys, "t_ms",
                       [Measure("c", here=True), Measure("n", here=True), Measure("n_in", range_ms=range_ms)]), "mirror-line")
    before = (F.col("c") - F.col("c_here")).cast(money)
    asks = (settled.withColumnRenamed(own, "acct").select(*keys, "t_ms", "e2e", "amt")
            .join(line.select(*keys, "t_ms", "c", "n", "n_in"), [*keys, "t_ms"]).where("n_in > 0"))
    per_rule = []
    for rule, doc in docs.items():
        params = doc["config"]["parameters"]
        kept = _dec(round(1 - params.get("commission", 0), 10))
        own_factor, flow_factor = (kept, _dec(1)) if own == "cdtr_acct" else (_dec(1), kept)
        goal = F.col("amt") * own_factor
        low, high = goal * _dec(round(1 - params["tolerance"], 10)), goal * _dec(round(1 + params["tolerance"], 10))
        per_rule.append(F.struct(
            F.lit(rule).alias("rule"),
            F.floor((F.col("c").cast(money) * flow_factor - low) / flow_factor, F.lit(2)).cast(money).alias("x"),
            high.cast("decimal(38,8)").alias("high"), flow_factor.cast("decimal(12,10)").alias("factor")))
    asks = asks.select(*keys, "t_ms", "e2e", "c", "n", F.inline(F.array(*per_rule))).where("x is not null")

    within = Window.partitionBy(*keys, "t_ms").orderBy("e2e").rowsBetween(Window.unboundedPreceding, -1)
    flow = (settled.withColumnRenamed(other, "acct").select(*keys, "t_ms", "e2e", F.col("amt").cast(money).alias("a"))
            .where("acct is not null").select(*keys, "t_ms", "e2e", F.coalesce(F.sum("a").over(within), F.lit(0)).alias("a"),
                                              F.count("a").over(within).alias("k")))
    lined = line.where("n_here > 0").select(*keys, "t_ms", before.alias("b"), (F.col("n") - F.col("n_here")).alias("n0"))
    at = (F.col("b") + F.col("a")).cast(money)
    items = flow.join(lined, [*keys, "t_ms"]).select(
        *keys, at.alias("x"), "t_ms", "e2e", F.lit(0).alias("kind"),
        F.struct(F.col("t_ms").alias("t"), at.alias("b"), (F.col("n0") + F.col("k")).alias("n")).alias("hit"))
    merged = items.unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    hits = last_up_to(merged, keys, ["x", "t_ms", "kind", "e2e"], "hit").where("kind = 1")
    summed = (F.col("c") - F.col("hit.b")).cast(money)
    match = (F.col("hit.t") >= F.col("t_ms") - range_ms) & (
        (summed * F.col("factor").cast("decimal(12,10)")).cast("decimal(38,8)") <= F.col("high"))
    hits = (hits.where(match).groupBy("tenant_id", "e2e")
            .agg(*[F.max(F.when(F.col("rule") == r, F.col("n") - F.col("hit.n"))).alias(f"v_{r}") for r in docs]))

    wide = (pay.withColumnRenamed(own, "acct")
            .join(line.select(*keys, "t_ms", "n_in"), [*keys, "t_ms"], "left")
            .join(hits, ["tenant_id", "e2e"], "left"))
    outs = []
    for rule, doc in docs.items():
        value = F.col(f"v_{rule}")
        leaves = F.when(F.col("acct").isNotNull(), F.when(F.coalesce(F.col("n_in"), F.lit(0)) < 1, ".x01")
                        .when(value.isNull(), ".x03"))
        outs.append(outcome(doc, value, leaves))
    return results(wide, outs)


def _mirror_by_range(pay: DataFrame, docs: Mapping[str, dict], own: str, other: str) -> DataFrame:
    """Rules sharing a range share one pass."""
    ranges: dict[int, dict] = {}
    for rule, doc in docs.items():
        ranges.setdefault(doc["config"]["parameters"]["maxQueryRange"], {})[rule] = doc
    return reduce(DataFrame.unionByName, [_mirror(pay, group, own, other) for group in ranges.values()])


def mirror_creditor(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame:
    """Rules 024 and 026: money received by the creditor account against what it has sent."""
    return _mirror_by_range(pay, docs, "cdtr_acct", "dbtr_acct")


def mirror_debtor(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame:
    """Rules 025 and 027: money sent by the debtor account against what it has received."""
    return _mirror_by_range(pay, docs, "dbtr_acct", "cdtr_acct")

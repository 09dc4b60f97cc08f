"""Rules answered by one pass over an account's time line: counts, dormancy, outliers, digit tests, volume.

Statistics are our definitions over the published limits (only the parameters, exits and bands are configuration).
Only settled payments contribute; unsettled ones still get a result. "Prior" is strictly earlier in milliseconds,
"previous" is the greatest (t_ms, e2e) among prior payments.
"""
from __future__ import annotations

from collections.abc import Mapping
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...config.rules import rule_config
from ...functions import haversine, leading_digit, levenshtein_distance
from ..outcome import outcome, results, validate_rule_config
from ..timeline import FOLD, Measure, coverage, scan

if TYPE_CHECKING:
    from ..kept import Kept

DEBTOR_RULES = ("002", "004", "007", "010", "017", "044", "048", "054", "074", "076", "901")
CREDITOR_RULES = ("001", "003", "011", "016", "020", "045", "063", "902")

HALF = 10 ** 9  # amounts in cents are kept as high and low part, whose products and their sums are exact
_BENFORD = {"054", "063"}
VOLUME = {"010", "011"}
BIN_MS = 86_400_000  # the interval of the volume rules that kept totals are made for
_ZSCORE = {"020", "048"}
_DISTINCT = {"002": "in", "016": "in", "017": "out"}


def fresh(kept: "Kept | None") -> Column:
    """Payments that are not in the kept totals; without kept totals, all."""
    return F.lit(True) if kept is None else ~F.col("carried")


def pair_scan(pay: DataFrame, kept: "Kept | None" = None) -> DataFrame:
    """Per (tenant, debtor account, creditor account, t): settled payments so far and the previous settled time."""
    settled_at = F.when(F.col("ok"), F.col("t_ms"))
    rows = pay.select("tenant_id", "dbtr_acct", "cdtr_acct", "t_ms", F.lit(True).alias("real"),
                      F.when(fresh(kept), F.col("ok").cast("bigint")).alias("pair_n"), settled_at.alias("pair_prev"))
    if kept is not None:
        rows = rows.unionByName(kept.pairs.select(
            "tenant_id", "dbtr_acct", "cdtr_acct", F.lit(kept.closed - 1).alias("t_ms"), F.lit(False).alias("real"), "pair_n",
            F.lit(None).cast("bigint").alias("pair_prev")))
    return scan(rows, ["tenant_id", "dbtr_acct", "cdtr_acct"], "t_ms",
                [Measure("pair_n", here=True), Measure("pair_prev", "max")])


def _measures(docs: Mapping[str, dict]) -> dict[str, tuple[Measure, Column | None, Column | None]]:
    """name -> (measure, contribution of own-side payments, contribution of payments on the other side)."""
    ok, t, amt = F.col("ok"), F.col("t_ms"), F.col("amt")
    one = F.when(ok, F.lit(1).cast("bigint"))
    out: dict = {}

    def add(name, measure, own, other=None):
        out[name] = (measure, own, other)

    for rule, doc in docs.items():
        params = doc["config"].get("parameters") or {}
        if rule == "001":
            add("first_any", Measure("first_any", "min"), F.when(ok, t), F.when(ok, t))
        elif rule in ("003", "004"):
            add("last_any", Measure("last_any", "max"), F.when(ok, t), F.when(ok, t))
        elif rule == "076":
            add("last_own", Measure("last_own", "max"), F.when(ok, t))
        elif rule == "007":
            add("last_text", Measure("last_text", "max"), F.when(ok, F.struct("t_ms", "e2e", "descr")))
        elif rule == "074":
            add("last_place", Measure("last_place", "max"), F.when(ok, F.struct("t_ms", "e2e", "lat", "lon")))
        elif rule in ("044", "045") or rule in VOLUME:
            add("n_all", Measure("n_all"), one)
        elif rule in ("901", "902"):
            name = f"n_{rule}"
            add(name, Measure(name, range_ms=params.get("maxQueryRange")), one)
        elif rule in _ZSCORE:
            add("z_n", Measure("z_n", here=True), one)
            cents = ((amt - F.col("ref")) * 100).cast("bigint")
            high = F.call_function("div", cents, F.lit(HALF))
            low = cents - high * HALF
            for name, part in (("h", high), ("l", low), ("hh", high * high), ("hl", high * low), ("ll", low * low)):
                add(f"z_{name}", Measure(f"z_{name}", here=True), F.when(ok, part.cast("decimal(28,0)")))
            add("z_low", Measure("z_low", "min"), F.when(ok, amt))
            add("z_high", Measure("z_high", "max"), F.when(ok, amt))
        elif rule in _BENFORD:
            for d in range(1, 10):
                add(f"d{d}", Measure(f"d{d}"), F.when(ok & (F.col("digit") == d), F.lit(1).cast("bigint")))
        elif rule in _DISTINCT:
            name = f"m_{rule}"
            add(name, Measure(name), F.lit(None).cast("bigint"))
    return out


def _distinct_steps(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame | None:
    wanted = [r for r in docs if r in _DISTINCT]
    if not wanted:
        return None
    pairs = pair_scan(pay).where("pair_n_here > 0")
    steps = None
    for rule in wanted:
        acct = "cdtr_acct" if _DISTINCT[rule] == "in" else "dbtr_acct"
        part = coverage(pairs.withColumnRenamed(acct, "acct"), ["tenant_id", "acct"], "t_ms", "pair_prev",
                        docs[rule]["config"]["parameters"]["maxQueryRange"], f"m_{rule}")
        steps = part if steps is None else steps.unionByName(part, allowMissingColumns=True)
    return steps


def _bin_counts(pay: DataFrame, acct: str, interval: int) -> DataFrame:
    k = F.floor(F.col("t_ms") / interval).cast("bigint")
    n = F.col("n").cast("decimal(15,0)")
    return (pay.groupBy("tenant_id", F.col(acct).alias("acct"), k.alias("bin"))
            .agg(F.sum(F.col("ok").cast("bigint")).alias("n"))
            .select("tenant_id", "acct", "bin", F.col("n").alias("bin_sum"), (n * n).alias("bin_sq"),
                    F.when(F.col("n") > 0, F.col("bin")).alias("bin_first")))


def _bins(pay: DataFrame, acct: str, interval: int, kept: "Kept | None" = None) -> DataFrame:
    """Per account and interval: settled payments in all earlier intervals, their squares, first active interval."""
    counts = _bin_counts(pay.where(fresh(kept)), acct, interval)
    if kept is not None:
        before = (kept.debtor if acct == "dbtr_acct" else kept.creditor).where("bin_sum is not null")
        counts = counts.unionByName(before.select(
            "tenant_id", "acct", F.lit(kept.closed // interval - 1).alias("bin"), "bin_sum", "bin_sq", "bin_first"))
    earlier = (Window.partitionBy("tenant_id", "acct").orderBy("bin")
               .rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("tenant_id", "acct", "bin", F.sum("bin_sum").over(earlier).alias("bin_sum"),
                         F.sum("bin_sq").over(earlier).alias("bin_sq"), F.min("bin_first").over(earlier).alias("bin_first"))


def _count_spread(n: Column, total: Column, squares: Column) -> tuple[Column, Column, Column]:
    """Mean, population standard deviation and whether all counts are equal: n·Σx² − (Σx)² in whole decimals, so nothing
    cancels; a sum beyond their range is an error, not another way."""
    exact = (n.cast("decimal(10,0)") * squares.cast("decimal(27,0)")
             - total.cast("decimal(18,0)") * total.cast("decimal(18,0)"))
    return total.cast("double") / n, F.sqrt(exact.cast("double")) / n, exact == 0


def _rule_columns(rule: str, doc: dict) -> tuple[Column, Column | None]:
    """Value and history exit of one rule over the scanned columns."""
    t, params = F.col("t_ms"), doc["config"].get("parameters") or {}
    if rule == "001":
        return t - F.col("first_any"), F.when(F.col("first_any").isNull(), ".x01")
    if rule in ("003", "004"):
        return t - F.col("last_any"), F.when(F.col("last_any").isNull(), ".x01")
    if rule == "076":
        return t - F.col("last_own"), F.when(F.col("last_own").isNull(), ".x01")
    if rule == "007":
        before = F.col("last_text.descr")
        return levenshtein_distance(F.col("descr"), before), F.when(F.col("last_text").isNull(), ".x01")
    if rule == "074":
        gap = t - F.col("last_place.t_ms")
        km = haversine(F.col("last_place.lat"), F.col("lat"), F.col("last_place.lon"), F.col("lon"))
        near = F.coalesce(gap <= params["maxQueryRange"], F.lit(False))
        return F.when(near, km / (gap / 3_600_000)), F.when(~near, ".x01")
    if rule in ("044", "045"):
        return F.col("n_all"), None
    if rule in ("901", "902"):
        return F.col(f"n_{rule}"), None
    if rule in _DISTINCT:
        return F.col(f"m_{rule}"), None
    if rule in _ZSCORE:
        # amounts are taken from the account's first one: it is among the prior ones, so nothing cancels
        n = F.col("z_n") - F.col("z_n_here")
        before = {k: F.col(f"z_{k}") - F.col(f"z_{k}_here") for k in ("h", "l", "hh", "hl", "ll")}
        spread = lambda xy, x, y: (n.cast("decimal(10,0)") * before[xy].cast("decimal(28,0)")
                                   - before[x].cast("decimal(19,0)") * before[y].cast("decimal(19,0)")).cast("double")
        scatter = (spread("hh", "h", "h") * HALF + 2 * spread("hl", "h", "l")) * HALF + spread("ll", "l", "l")
        total = before["h"].cast("double") * HALF + before["l"].cast("double")
        flat = F.col("z_low") == F.col("z_high")
        leaves = F.when(n < 1, ".x01").when(flat & (F.col("amt") > F.col("z_high")), ".x03").when(flat, ".x04")
        apart = ((F.col("amt") - F.col("ref")) * 100).cast("double") - total / n
        return F.when((n > 0) & ~flat, apart / (F.sqrt(scatter) / n)), leaves
    if rule in _BENFORD:
        counts = [F.col(f"d{d}") for d in range(1, 10)]
        n = sum(counts[1:], counts[0])
        chi = F.lit(0.0)
        for d, seen in enumerate(counts, start=1):
            expected = n * F.log10(F.lit(1.0 + 1.0 / d))
            chi = chi + (seen - expected) * (seen - expected) / expected
        enough = n >= params["minimumNumberOfTransactions"]
        return F.when(enough, chi), F.when(~enough, ".x01")
    bins = F.col("bin") - F.col("bin_first")
    now = F.col("n_all") - F.coalesce(F.col("bin_sum"), F.lit(0))
    mean, sd, flat = _count_spread(bins, F.col("bin_sum"), F.col("bin_sq"))
    short = F.coalesce(bins < 2, F.lit(True))
    leaves = F.when(short, ".x01").when(flat & (now * bins > F.col("bin_sum")), ".x03").when(flat, ".x04")
    return F.when(~short & ~flat, (now - mean) / sd), leaves


def _with_refs(pay: DataFrame, own: str, known: DataFrame | None = None, kept: "Kept | None" = None) -> DataFrame:
    """Adds ``ref``, the account's first amount; one that is ``known`` stays."""
    refs = (pay.where(F.col("ok") & fresh(kept)).groupBy("tenant_id", own)
            .agg(F.min_by("amt", F.when(F.col("amt").isNotNull(), F.struct("t_ms", "e2e"))).alias("ref")))
    if known is not None:
        told = known.select("tenant_id", F.col("acct").alias(own), F.col("ref").alias("_told"))
        refs = refs.join(told, ["tenant_id", own], "full_outer").select("tenant_id", own, F.coalesce("_told", "ref").alias("ref"))
    return pay.join(refs, ["tenant_id", own], "left")


def _contributions(given: DataFrame, measures: Mapping[str, tuple], own: str, other: str, kept: "Kept | None" = None) -> DataFrame:
    """What each payment adds to the measures of its account, and of the account on the other side where any asks."""
    cells = [F.col(own).alias("acct"), F.col("t_ms").alias("t_ms"), F.lit(True).alias("real")]
    mirror = [F.col(other).alias("acct"), F.col("t_ms").alias("t_ms"), F.lit(False).alias("real")]
    for name, (measure, own_value, other_value) in measures.items():
        counts = lambda c: c if kept is None or measure.range_ms is not None else F.when(fresh(kept), c)
        cells.append(counts(own_value).alias(name))
        mirror.append(counts(other_value if other_value is not None else F.when(F.lit(False), own_value)).alias(name))
    if any(o is not None for _, _, o in measures.values()):
        both = given.select("tenant_id", *[F.struct(*c).alias(n) for c, n in ((cells, "_own"), (mirror, "_other"))])
        return both.select("tenant_id", F.inline(F.array("_own", "_other")))
    return given.select("tenant_id", *cells)


def _unbounded(own: str) -> dict[str, tuple]:
    """Measures over all time, of every rule of a side."""
    rules = DEBTOR_RULES if own == "dbtr_acct" else CREDITOR_RULES
    return {name: parts for name, parts in _measures({r: rule_config(r) for r in rules}).items()
            if parts[0].range_ms is None and not name.startswith("m_")}


def totals(pay: DataFrame, own: str, other: str, known: DataFrame | None = None) -> DataFrame:
    """All measures without a look-back, of every account: what ``scan`` would carry past these payments. ``known``
    totals give the first amounts that sums are taken from."""
    measures = _unbounded(own)
    given = _with_refs(pay, own, known).withColumn("digit", leading_digit(F.col("amt")))
    folded = _contributions(given, measures, own, other).where("acct is not null").groupBy("tenant_id", "acct").agg(
        *[FOLD[m.op](n).alias(n) for n, (m, _, _) in measures.items()])
    bins = _bin_counts(pay.where(F.col(own).isNotNull()), own, BIN_MS).groupBy("tenant_id", "acct").agg(
        F.sum("bin_sum").alias("bin_sum"), F.sum("bin_sq").alias("bin_sq"), F.min("bin_first").alias("bin_first"))
    refs = given.where("ref is not null").groupBy("tenant_id", F.col(own).alias("acct")).agg(F.first("ref").alias("ref"))
    return folded.join(bins, ["tenant_id", "acct"], "left").join(refs, ["tenant_id", "acct"], "left")


def merge_totals(rows: DataFrame, own: str) -> DataFrame:
    """Totals of two stretches of time, whose sums were taken from the same first amounts."""
    ops = {**{n: m.op for n, (m, _, _) in _unbounded(own).items()}, "bin_sum": "sum", "bin_sq": "sum", "bin_first": "min",
           "ref": "max"}
    return rows.groupBy("tenant_id", "acct").agg(*[
        FOLD[op](n).cast(rows.schema[n].dataType).alias(n) for n, op in ops.items()])


def evaluate(pay: DataFrame, docs: Mapping[str, dict], own: str, other: str, kept: "Kept | None" = None) -> DataFrame:
    measures = _measures(docs)
    before = None if kept is None else kept.debtor if own == "dbtr_acct" else kept.creditor
    if _ZSCORE & set(docs):
        pay = _with_refs(pay, own, before, kept)
    given = pay.withColumn("digit", leading_digit(F.col("amt"))) if _BENFORD & set(docs) else pay
    rows = _contributions(given, measures, own, other, kept)
    held = [] if before is None else [n for n in measures if n in before.columns]
    if held:
        rows = rows.unionByName(before.select(
            "tenant_id", "acct", F.lit(kept.closed - 1).alias("t_ms"), F.lit(False).alias("real"),
            *[F.col(n).cast(rows.schema[n].dataType).alias(n) for n in held]), allowMissingColumns=True)
    line = scan(rows, ["tenant_id", "acct"], "t_ms", [m for m, _, _ in measures.values()],
                deltas=_distinct_steps(pay, docs))
    wide = pay.withColumnRenamed(own, "acct").join(line, ["tenant_id", "acct", "t_ms"], "left")
    volume = [r for r in docs if r in VOLUME]
    if volume:
        interval = docs[volume[0]]["config"]["parameters"]["evaluationIntervalTime"]
        wide = (wide.withColumn("bin", F.floor(F.col("t_ms") / interval).cast("bigint"))
                .join(_bins(pay, own, interval, kept), ["tenant_id", "acct", "bin"], "left"))
    outs = []
    for rule, doc in docs.items():
        value, leaves = _rule_columns(rule, doc)
        # a payment without the account has no history to be short of: no value, no exit, but a result
        known = None if leaves is None else F.when(F.col("acct").isNotNull(), leaves)
        outs.append(outcome(doc, F.when(F.col("acct").isNotNull(), value), known))
    return results(wide, outs)


def debtor(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    return evaluate(pay, docs, "dbtr_acct", "cdtr_acct", kept)


def creditor(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    return evaluate(pay, docs, "cdtr_acct", "dbtr_acct", kept)


def pair(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    """Rule 030: settled payments so far between this debtor and this creditor account."""
    wide = pay.join(pair_scan(pay, kept).drop("pair_prev"), ["tenant_id", "dbtr_acct", "cdtr_acct", "t_ms"],
                    "left")
    return results(wide, [outcome(docs["030"], F.col("pair_n"))])


def row_local(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame:
    """Rules 028 (age in whole years at payment), 078 (transaction type) and 091 (amount): no history, no shuffle."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t_ms") / 86_400_000).cast("int"))
    birth = F.col("birth_date")
    month_day = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    age = F.year(day) - F.year(birth) - (month_day(day) < month_day(birth)).cast("int")
    values = {"028": age, "078": F.col("tx_kind"), "091": F.col("amt")}
    return results(pay, [outcome(doc, values[rule]) for rule, doc in docs.items()])


def holders(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    """Rules 083 and 084: accounts that the paying and the paid entity have held up to the payment's time."""
    ends = F.array(F.struct(F.col("dbtr_id").alias("entity"), F.col("dbtr_acct").alias("acct"), "t_ms"),
                   F.struct(F.col("cdtr_id").alias("entity"), F.col("cdtr_acct").alias("acct"), "t_ms"))
    seen = pay.select("tenant_id", F.inline(ends))
    told = seen if kept is None else seen.unionByName(kept.holders.select("tenant_id", "entity", "acct", "t_ms"))
    firsts = (told.where("acct is not null").groupBy("tenant_id", "entity", "acct").agg(F.min("t_ms").alias("t_ms"))
              .select("tenant_id", "entity", "t_ms", F.lit(False).alias("real"), F.lit(1).cast("bigint").alias("held")))
    moments = seen.select("tenant_id", "entity", "t_ms", F.lit(True).alias("real"), F.lit(None).cast("bigint").alias("held"))
    held = scan(moments.unionByName(firsts), ["tenant_id", "entity"], "t_ms", [Measure("held")])
    sides = {"083": "dbtr_id", "084": "cdtr_id"}
    wide = pay
    for rule in docs:
        wide = wide.join(held.withColumnsRenamed({"entity": sides[rule], "held": f"held_{rule}"}),
                         ["tenant_id", sides[rule], "t_ms"], "left")
    return results(wide, [outcome(doc, F.col(f"held_{rule}")) for rule, doc in docs.items()])


def checked(docs: Mapping[str, dict]) -> Mapping[str, dict]:
    for rule, doc in docs.items():
        validate_rule_config(doc, NUMERIC.get(rule, ()))
    return docs


# Parameters a rule cannot do without.
NUMERIC = {"002": ("maxQueryRange",), "016": ("maxQueryRange",), "017": ("maxQueryRange",),
           "018": ("maxQueryRange",), "006": ("tolerance", "maxQueryLimit"), "008": ("maxQueryLimit",),
           "010": ("evaluationIntervalTime",), "011": ("evaluationIntervalTime",), "021": ("tolerance",),
           "024": ("tolerance", "maxQueryRange"), "025": ("tolerance", "maxQueryRange"),
           "026": ("tolerance", "maxQueryRange", "commission"), "027": ("tolerance", "maxQueryRange", "commission"),
           "054": ("minimumNumberOfTransactions",), "063": ("minimumNumberOfTransactions",),
           "074": ("maxQueryRange",), "075": ("maxRadius",),
           "090": ("maxQueryRangeUpstream", "maxQueryRangeDownstream")}

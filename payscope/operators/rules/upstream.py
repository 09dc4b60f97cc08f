"""Rule 090: how many payees did the payers of this debtor account have?

Statistic (ours): distinct payees q such that some payer p paid the debtor account within the upstream range before
t and paid q within the downstream range before t (both strictly earlier; the debtor account itself counts).

Payments are first folded to stretches of time: pair (a, b) is active from one millisecond after a payment until
``range`` later, in disjoint pieces, cut at bucket edges. In each bucket one of an account's payers, the one with most
payees, is only counted: while it is active, its own running number of payees is taken. The payees of the other payers
are listed, and those that the counted payer reaches at the same time are left out by one look-up for each. A payer of
very many payees who pays very many accounts thus costs a row for each payment; payees are listed for an account only
where two of its payers are at work in one bucket, and then those of the lesser ones.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...sources.shared import staged
from ..outcome import outcome, results
from ..timeline import Measure, block_of, scan


def _pieces(pairs: DataFrame, range_ms: int) -> DataFrame:
    """Disjoint half-open pieces [lo, hi) in which each pair has a payment in [t - range, t - 1]."""
    lo = F.greatest(F.col("t_ms") + 1, F.coalesce(F.col("pair_prev") + range_ms + 1, F.col("t_ms") + 1))
    return pairs.select("tenant_id", "dbtr_acct", "cdtr_acct", lo.alias("lo"),
                        (F.col("t_ms") + range_ms + 1).alias("hi"))


def _bucketed(pieces: DataFrame, width: int) -> DataFrame:
    """Cut pieces at bucket edges."""
    b = F.explode(F.sequence(block_of(F.col("lo"), width), block_of(F.col("hi") - 1, width)))
    return (pieces.withColumn("bucket", b)
            .withColumns({"lo": F.greatest(F.col("lo"), F.col("bucket") * width),
                          "hi": F.least(F.col("hi"), (F.col("bucket") + 1) * width)}))


def _steps(keys: list[str], name: str, lo: Column, hi: Column) -> list[Column]:
    """+1 where a piece begins, -1 where it ends."""
    one = F.lit(1).cast("bigint")
    return [*keys, F.inline(F.array(*[F.struct(at.alias("t_ms"), sign.alias(name)) for at, sign in ((lo, one), (hi, -one))]))]


def divergence(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame:
    doc = docs["090"]
    params = doc["config"]["parameters"]
    up, down = int(params["maxQueryRangeUpstream"]), int(params["maxQueryRangeDownstream"])
    width = max(up, down)
    pair = ["tenant_id", "dbtr_acct", "cdtr_acct"]
    settled = pay.where("ok").select(*pair, "t_ms", F.lit(True).alias("real"), F.col("t_ms").alias("pair_prev"))
    pairs = staged(scan(settled, pair, "t_ms", [Measure("pair_prev", "max")]), "upstream-pairs")
    debtors = pay.select("tenant_id", F.col("dbtr_acct").alias("acct")).distinct()
    paid = _pieces(pairs, down).withColumnsRenamed({"dbtr_acct": "payer", "cdtr_acct": "payee"})
    out = _bucketed(paid, width).withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    into = (_bucketed(_pieces(pairs, up), width).withColumnsRenamed({"dbtr_acct": "payer", "cdtr_acct": "acct"})
            .join(debtors, ["tenant_id", "acct"], "left_semi"))

    degrees = out.groupBy("tenant_id", "payer", "bucket").agg(F.count(F.lit(1)).alias("degree"))
    ranked = into.join(degrees, ["tenant_id", "payer", "bucket"], "left")
    counted = ranked.groupBy("tenant_id", "acct", "bucket").agg(
        F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "payer"))["payer"].alias("counted"))
    into = staged(into.join(counted, ["tenant_id", "acct", "bucket"]), "upstream-payers")
    counted = into.select("tenant_id", "acct", "bucket", "counted").distinct()
    chosen, others = into.where("payer = counted"), into.where("payer <> counted")

    lo, hi = F.greatest("lo", "lo2"), F.least("hi", "hi2")
    listed = staged(others.join(out, ["tenant_id", "payer", "bucket"]).where(lo < hi).select(
        "tenant_id", "acct", "bucket", "counted", "payee", lo.alias("lo"), hi.alias("hi")), "upstream-listed")
    known = out.withColumnRenamed("payer", "counted")
    again = (listed.select("tenant_id", "acct", "bucket", "counted", "payee").distinct()
             .join(known, ["tenant_id", "counted", "bucket", "payee"])
             .join(chosen.select("tenant_id", "acct", "bucket", "lo", "hi"), ["tenant_id", "acct", "bucket"]).where(lo < hi))
    three = ["tenant_id", "acct", "payee"]
    steps = (listed.select(*_steps(three, "depth", F.col("lo"), F.col("hi")))
             .unionByName(again.select(*_steps(three, "held", lo, hi)), allowMissingColumns=True))
    depth = scan(steps.withColumn("real", F.lit(True)), three, "t_ms", [Measure("depth", here=True), Measure("held", here=True)])
    counts = (F.col("depth") > 0) & (F.col("held") == 0)
    did = (F.col("depth") > F.col("depth_here")) & (F.col("held") == F.col("held_here"))
    change = counts.cast("bigint") - did.cast("bigint")
    changes = staged(depth.select("tenant_id", "acct", "t_ms", change.alias("payees")).where("payees <> 0"), "upstream-payees")

    active = chosen.select(*_steps(["tenant_id", "acct"], "active", F.col("lo"), F.col("hi")))
    none = F.lit(None).cast("bigint")
    rows = pay.select("tenant_id", F.col("dbtr_acct").alias("acct"), "t_ms", F.lit(True).alias("real"),
                      none.alias("payees"), none.alias("active"))
    line = staged(scan(rows, ["tenant_id", "acct"], "t_ms", [Measure("payees"), Measure("active")],
                       deltas=changes.unionByName(active, allowMissingColumns=True))
                  .withColumn("bucket", block_of(F.col("t_ms"), width))
                  .join(counted, ["tenant_id", "acct", "bucket"], "left")
                  .select("tenant_id", "acct", "t_ms", "payees", F.when(F.col("active") > 0, F.col("counted")).alias("payer")),
                  "upstream-line")
    asks = line.where("payer is not null").select("tenant_id", "payer", "t_ms", F.lit(True).alias("real"), none.alias("reached"))
    reached = scan(asks, ["tenant_id", "payer"], "t_ms", [Measure("reached")],
                   deltas=paid.select(*_steps(["tenant_id", "payer"], "reached", F.col("lo"), F.col("hi"))))
    found = line.join(reached, ["tenant_id", "payer", "t_ms"], "left").select(
        "tenant_id", "acct", "t_ms", (F.col("payees") + F.coalesce("reached", F.lit(0))).alias("payees"))
    wide = pay.withColumnRenamed("dbtr_acct", "acct").join(found, ["tenant_id", "acct", "t_ms"], "left")
    return results(wide, [outcome(doc, F.col("payees"))])

"""Entity and account conditions: interval join, conditions in force, event-flow outcome, administration."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import STATUS
from .timeline import Measure, block_of, scan

# Precedence (ours), strongest first; ``block`` is an alias of the first.
PRECEDENCE = ("non-overridable-block", "override", "overridable-block")
ALIASES = {"block": "non-overridable-block"}

_SUBJECTS = (("debtor", "account", "dbtr_acct"), ("creditor", "account", "cdtr_acct"),
             ("debtor", "entity", "dbtr_id"), ("creditor", "entity", "cdtr_id"))


def conditions_of(edges: DataFrame) -> DataFrame:
    """The condition table behind governed edges: one row per condition."""
    return edges.select("tenant_id", F.col("destination").alias("cond_id"), F.col("outcome").alias("cond_tp"),
                        F.col("incptn_ms").alias("cre_ms"), F.col("xprtn_ms").alias("upd_ms"))


def in_force(at: Column) -> Column:
    return (F.col("incptn_ms") <= at) & (F.col("xprtn_ms").isNull() | (at < F.col("xprtn_ms")))


def conditions_at(edges: DataFrame, at_ms: int) -> DataFrame:
    return edges.where(in_force(F.lit(at_ms)))


def _subject_rows(pay: DataFrame) -> DataFrame:
    return pay.select("tenant_id", "e2e", "t_ms", F.inline(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(kind).alias("subject_type"), F.col(c).alias("source"))
        for role, kind, c in _SUBJECTS])))


#: Conditions are cut at days; one that lasts longer than so many is met by its subject alone.
BUCKET_MS = 86_400_000
MOST_BUCKETS = 400


def interval_join(pay: DataFrame, edges: DataFrame, tx_tp: str = STATUS) -> DataFrame:
    """Every event with every condition in force for one of its four subjects.

    A condition is cut into the days it touches and meets the events of its subject on those days only, so conditions
    that are over cost nothing on later days; an event lies in one day, so a pair is met once. Conditions without an end,
    or that last very long, meet all events of their subject, nearly all of which they govern.
    """
    keys = ["tenant_id", "role", "subject_type", "source"]
    relevant = edges.where(F.array_contains("evt_tp", tx_tp))
    first, last = block_of(F.col("incptn_ms"), BUCKET_MS), block_of(F.col("xprtn_ms") - 1, BUCKET_MS)
    short = F.coalesce((F.col("xprtn_ms") > F.col("incptn_ms")) & (last - first < MOST_BUCKETS), F.lit(False))
    never = F.coalesce(F.col("xprtn_ms") <= F.col("incptn_ms"), F.lit(False))
    cut = relevant.where(short & ~never).withColumn("bucket", F.explode(F.sequence(first, last)))
    long = relevant.where(~short & ~never)
    subjects = _subject_rows(pay)
    daily = subjects.withColumn("bucket", block_of(F.col("t_ms"), BUCKET_MS)).join(cut, [*keys, "bucket"]).drop("bucket")
    return daily.unionByName(subjects.join(long, keys).select(*daily.columns)).where(in_force(F.col("t_ms")))


def event_flow(pay: DataFrame, edges: DataFrame, tx_tp: str = STATUS) -> DataFrame:
    """Strongest condition in force per event (tenant_id, e2e, outcome), ``none`` if there is none.

    Counts of conditions in force come from a running sum of starts and ends per subject, so a subject with many
    conditions and many payments is never multiplied out; payments of ungoverned subjects do not take part.
    """
    keys = ["tenant_id", "role", "subject_type", "source"]
    kind = F.col("outcome")
    for alias, name in ALIASES.items():
        kind = F.when(kind == alias, F.lit(name)).otherwise(kind)
    relevant = edges.where(F.array_contains("evt_tp", tx_tp)).withColumn("_kind", kind)
    names = [f"k{i}" for i in range(len(PRECEDENCE))]

    def step(at, sign):
        return F.struct(at.alias("t_ms"), *[F.when(F.col("_kind") == k, F.lit(sign).cast("bigint")).alias(n)
                                            for n, k in zip(names, PRECEDENCE)])

    steps = (relevant.select(*keys, F.inline(F.array(step(F.col("incptn_ms"), 1), step(F.col("xprtn_ms"), -1))))
             .where("t_ms is not null"))
    governed = relevant.select(*keys).distinct()
    rows = _subject_rows(pay).join(governed, keys, "left_semi")
    asks = rows.select(*keys, "t_ms", F.lit(True).alias("real"), *[F.lit(None).cast("bigint").alias(n) for n in names])
    line = scan(asks, keys, "t_ms", [Measure(n) for n in names], deltas=steps)
    rank = F.coalesce(*[F.when(F.col(n) > 0, F.lit(i)) for i, n in enumerate(names)])
    strongest = (rows.join(line, [*keys, "t_ms"]).groupBy("tenant_id", "e2e").agg(F.min(rank).alias("_rank")))
    label = F.get(F.array(*[F.lit(k) for k in PRECEDENCE]), F.col("_rank"))
    return (pay.select("tenant_id", "e2e").join(strongest, ["tenant_id", "e2e"], "left")
            .select("tenant_id", "e2e", F.coalesce(label, F.lit("none")).alias("outcome")))


def condition_admin(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Create or expire conditions: a change with a known key sets its expiry, others are added."""
    keys = ["tenant_id", "role", "subject_type", "source", "destination"]
    expiry = changes.select(*keys, F.col("xprtn_ms").alias("_until"), F.lit(True).alias("_hit"))
    kept = edges.join(expiry, keys, "left").select(
        *[F.when(F.col("_hit"), F.col("_until")).otherwise(F.col("xprtn_ms")).alias("xprtn_ms") if c == "xprtn_ms"
          else F.col(c) for c in edges.columns])
    return kept.unionByName(changes.join(edges.select(*keys), keys, "left_anti").select(*edges.columns))

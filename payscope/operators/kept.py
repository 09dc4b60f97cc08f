"""Totals of closed time: what rules without a look-back need to know of payments before a day's edge.

A stream that has closed all days before ``closed`` keeps seven tables instead of rereading history: totals of every
account on either side, payments of every pair, accounts of every entity, the latest payments and each day's largest one
of every debtor account, and its payments by place. Each is a fold of payments that can be merged with another fold, so
a closing day costs one pass over that day and the tables. Rules add the payments since the edge to the totals.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import account

DAY_MS = 86_400_000
#: Latest payments kept of a debtor account, more than any rule's limit asks for (a rule that asks for more rereads).
LATEST = 16


@dataclass(frozen=True)
class Kept:
    """Kept tables for the accounts and entities at hand; payments before ``closed`` are in them (column ``carried``).
    Those that no rule at hand reads (``needed``) may be None."""

    closed: int
    debtor: DataFrame | None = None
    creditor: DataFrame | None = None
    pairs: DataFrame | None = None
    holders: DataFrame | None = None
    latest: DataFrame | None = None
    tops: DataFrame | None = None
    places: DataFrame | None = None


def pairs(pay: DataFrame) -> DataFrame:
    return (pay.where("ok and dbtr_acct is not null and cdtr_acct is not null")
            .groupBy("tenant_id", "dbtr_acct", "cdtr_acct").agg(F.count(F.lit(1)).alias("pair_n")))


def holders(pay: DataFrame) -> DataFrame:
    ends = F.array(*[F.struct(F.col(e).alias("entity"), F.col(a).alias("acct"), "t_ms")
                     for e, a in (("dbtr_id", "dbtr_acct"), ("cdtr_id", "cdtr_acct"))])
    return _earliest(pay.select("tenant_id", F.inline(ends)).where("acct is not null and entity is not null"))


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id", "entity", "acct").agg(F.min("t_ms").alias("t_ms"))


def latest(pay: DataFrame) -> DataFrame:
    return _newest(pay.where("ok and dbtr_acct is not null").select("tenant_id", "dbtr_acct", "t_ms", "e2e", "amt", "cdtr_acct"))


def _newest(rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy("tenant_id", "dbtr_acct").orderBy(F.desc("t_ms"), F.desc("e2e"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= LATEST).drop("_rank")


def tops(pay: DataFrame) -> DataFrame:
    day = ((F.col("t_ms") - F.pmod("t_ms", F.lit(DAY_MS))) / DAY_MS).cast("long")
    return _highest(pay.where("ok and dbtr_acct is not null and amt is not null").select(
        "tenant_id", "dbtr_acct", day.alias("day"), F.col("amt").alias("top"), "t_ms"))


def _highest(rows: DataFrame) -> DataFrame:
    most = F.max(F.struct("top", "t_ms")).alias("_most")
    return rows.groupBy("tenant_id", "dbtr_acct", "day").agg(most).select("tenant_id", "dbtr_acct", "day", "_most.*")


def places(pay: DataFrame) -> DataFrame:
    return (pay.where("ok and dbtr_acct is not null and lat is not null and lon is not null")
            .groupBy("tenant_id", "dbtr_acct", "lat", "lon").agg(F.count(F.lit(1)).alias("n")))


@dataclass(frozen=True)
class Table:
    """``fold(payments, known)`` makes the table of some payments, ``merge`` folds the union of two tables."""

    fold: Callable[[DataFrame, DataFrame | None], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]


def _summed(keys: tuple[str, ...], name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(F.sum(name).alias(name))


_PAIR, _PLACE = ("tenant_id", "dbtr_acct", "cdtr_acct"), ("tenant_id", "dbtr_acct", "lat", "lon")
TABLES: dict[str, Table] = {
    "debtor": Table(lambda pay, known: account.totals(pay, "dbtr_acct", "cdtr_acct", known),
                    lambda rows: account.merge_totals(rows, "dbtr_acct"), ("tenant_id", "acct")),
    "creditor": Table(lambda pay, known: account.totals(pay, "cdtr_acct", "dbtr_acct", known),
                      lambda rows: account.merge_totals(rows, "cdtr_acct"), ("tenant_id", "acct")),
    "pairs": Table(lambda pay, _: pairs(pay), _summed(_PAIR, "pair_n"), _PAIR),
    "holders": Table(lambda pay, _: holders(pay), _earliest, ("tenant_id", "entity", "acct")),
    "latest": Table(lambda pay, _: latest(pay), _newest, ("tenant_id", "dbtr_acct")),
    "tops": Table(lambda pay, _: tops(pay), _highest, ("tenant_id", "dbtr_acct", "day")),
    "places": Table(lambda pay, _: places(pay), _summed(_PLACE, "n"), _PLACE),
}


#: Rules that read a table; other rules see one payment or look back over a bounded range.
READERS = {"debtor": {"004", "007", "010", "044", "048", "054", "074", "075", "076"},
           "creditor": {"001", "003", "011", "020", "045", "063"}, "pairs": {"030"}, "holders": {"083", "084"},
           "latest": {"006", "008"}, "tops": {"018"}, "places": {"075"}}


def needed(docs: Iterable[dict]) -> set[str]:
    """Names of the tables that some rules read."""
    rules = {d["id"].split("@")[0] for d in docs}
    return {name for name, readers in READERS.items() if rules & readers}


def fits(doc: dict) -> bool:
    """Whether a rule's parameters suit the kept tables and a bounded window; any other rule rereads history."""
    rule, params = doc["id"].split("@")[0], doc["config"].get("parameters") or {}
    if rule in account.VOLUME:
        return params.get("evaluationIntervalTime") == account.BIN_MS
    if rule in ("006", "008"):
        return int(params["maxQueryLimit"]) <= LATEST
    return rule in UNBOUNDED or rule in NO_HISTORY or window_of(doc) is not None


#: Rules that the tables answer together with the open payments, rules that see one payment, and look-backs by parameter.
UNBOUNDED = {"001", "003", "004", "006", "007", "008", "010", "011", "018", "020", "030", "044", "045", "048", "054", "063",
             "075", "076", "083", "084"}
NO_HISTORY = {"028", "078", "091"}
RANGES = {**dict.fromkeys(("002", "016", "017", "021", "024", "025", "026", "027", "074", "901", "902"), ("maxQueryRange",)),
          "090": ("maxQueryRangeUpstream", "maxQueryRangeDownstream")}


def window_of(doc: dict) -> int | None:
    """Milliseconds that a bounded rule looks back; None for any other."""
    names = RANGES.get(doc["id"].split("@")[0])
    values = [doc["config"]["parameters"].get(n) for n in names or ()]
    return max(int(v) for v in values) if values and None not in values else None

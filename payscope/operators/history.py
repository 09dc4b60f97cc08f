"""The property graph of entities, accounts, payments and conditions, and the joins over it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import SETTLED, STATUS, TRANSFER

ROLES = [(role, kind) for kind in ("account", "entity") for role in ("creditor", "debtor")]


def _ends(pay: DataFrame) -> DataFrame:
    return pay.select("tenant_id", "req_ms", F.inline(F.array(
        F.struct(F.col("dbtr_id").alias("entity"), F.col("dbtr_acct").alias("account")),
        F.struct(F.col("cdtr_id").alias("entity"), F.col("cdtr_acct").alias("account")))))


def build_entities(pay: DataFrame) -> DataFrame:
    return _ends(pay).groupBy("tenant_id", F.col("entity").alias("id")).agg(F.min("req_ms").alias("cre_ms"))


def build_accounts(pay: DataFrame) -> DataFrame:
    return _ends(pay).groupBy("tenant_id", F.col("account").alias("id")).agg(F.min("req_ms").alias("cre_ms"))


def build_account_holders(pay: DataFrame) -> DataFrame:
    return (_ends(pay).groupBy("tenant_id", F.col("entity").alias("source"), F.col("account").alias("destination"))
            .agg(F.min("req_ms").alias("cre_ms")))


def build_transactions(pay: DataFrame) -> DataFrame:
    """Two edges per payment: the transfer debtor -> creditor with its amount, the status creditor -> debtor."""
    def edge(source, destination, tx_tp, at, amt, status):
        return F.struct(F.col(source).alias("source"), F.col(destination).alias("destination"),
                        F.lit(tx_tp).alias("tx_tp"), F.col(at).alias("cre_ms"), amt.alias("amt"),
                        status.alias("tx_sts"))
    none = F.lit(None)
    return pay.select("tenant_id", F.col("e2e").alias("end_to_end_id"), F.inline(F.array(
        edge("dbtr_acct", "cdtr_acct", TRANSFER, "req_ms", F.col("amt"), none.cast("string")),
        edge("cdtr_acct", "dbtr_acct", STATUS, "t_ms", none.cast("decimal(18,2)"),
             F.when(F.col("ok"), SETTLED).otherwise("RJCT")))))


def settled_filter(transactions: DataFrame) -> DataFrame:
    return transactions.where((F.col("tx_tp") == STATUS) & (F.col("tx_sts") == SETTLED))


def time_range_filter(rows: DataFrame, time: str, at: int, range_ms: int | None) -> DataFrame:
    """Rows up to ``at``, and not older than ``range_ms`` before it unless the range is open; ends inclusive."""
    rows = rows.where(F.col(time) <= at)
    return rows if range_ms is None else rows.where(F.col(time) >= at - range_ms)


def distinct_e2e(transactions: DataFrame) -> DataFrame:
    return transactions.select("tenant_id", "end_to_end_id").distinct()


def settled_amounts(transactions: DataFrame) -> DataFrame:
    """Amounts of settled payments by transfer."""
    done = distinct_e2e(settled_filter(transactions))
    return (transactions.where(F.col("tx_tp") == TRANSFER).join(done, ["tenant_id", "end_to_end_id"])
            .select("tenant_id", "end_to_end_id", "source", "destination", "amt", "cre_ms"))


def newest_first(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(time).desc(), *[F.col(c).desc() for c in ties])


def data_cache(statuses: DataFrame, transfers: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Per status message: accounts, amounts and rate of its transfer, and the accounts' holders if given."""
    transfer = transfers.select(
        "tenant_id", "end_to_end_id", F.col("debtor_account_id").alias("dbtr_acct_id"),
        F.col("creditor_account_id").alias("cdtr_acct_id"), "instd_amt", "intr_bk_sttlm_amt", "xchg_rate", "ccy",
        F.col("cre_dt_tm").alias("req_dt_tm"))
    rows = (statuses.select("tenant_id", "end_to_end_id", F.col("message_id").alias("msg_id"), "cre_dt_tm", "tx_sts")
            .join(transfer, ["tenant_id", "end_to_end_id"], "left"))
    if holders is not None:
        held = holders.groupBy("tenant_id", "account").agg(F.min("entity").alias("entity"))
        for side in ("dbtr", "cdtr"):
            rows = rows.join(held.select("tenant_id", F.col("account").alias(f"{side}_acct_id"),
                                         F.col("entity").alias(f"{side}_id")), ["tenant_id", f"{side}_acct_id"], "left")
    return rows


def holder_entities(holders: DataFrame, entities: DataFrame) -> DataFrame:
    named = entities.select("tenant_id", F.col("id").alias("source"), F.col("cre_ms").alias("entity_cre_ms"))
    return holders.join(named, ["tenant_id", "source"])


def holder_accounts(holders: DataFrame, accounts: DataFrame) -> DataFrame:
    named = accounts.select("tenant_id", F.col("id").alias("destination"), F.col("cre_ms").alias("account_cre_ms"))
    return holders.join(named, ["tenant_id", "destination"])


def tx_destination(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    return holder_accounts(transactions, accounts)


def account_transactions(accounts: DataFrame, transactions: DataFrame, direction: str) -> DataFrame:
    """Account -> its transactions as source (``out``) or destination (``in``), flat: one row per edge."""
    end = "source" if direction == "out" else "destination"
    return accounts.select("tenant_id", F.col("id").alias(end)).join(transactions, ["tenant_id", end])


def governed_subjects(edges: DataFrame, accounts: DataFrame, entities: DataFrame) -> DataFrame:
    """The four kinds of governed edge with the account or entity they belong to."""
    subjects = reduce(DataFrame.unionByName, [
        t.select("tenant_id", F.lit(kind).alias("subject_type"), F.col("id").alias("source"),
                 F.col("cre_ms").alias("subject_cre_ms")) for kind, t in (("account", accounts), ("entity", entities))])
    return edges.join(subjects, ["tenant_id", "subject_type", "source"])


def governed_conditions(edges: DataFrame, conditions: DataFrame) -> DataFrame:
    named = conditions.select("tenant_id", F.col("cond_id").alias("destination"), "cond_tp", F.col("cre_ms").alias("cond_cre_ms"))
    return edges.join(named, ["tenant_id", "destination"])


def subject_conditions(subjects: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Entity or account -> its governed edges, flat."""
    return (subjects.select("tenant_id", F.col("id").alias("source"))
            .join(edges.where(F.col("subject_type") == kind), ["tenant_id", "source"]))


def condition_subjects(conditions: DataFrame, edges: DataFrame) -> DataFrame:
    """Condition -> its subjects in all four roles, flat."""
    return (conditions.select("tenant_id", F.col("cond_id").alias("destination"))
            .join(edges, ["tenant_id", "destination"])
            .select("tenant_id", "destination", "role", "subject_type", "source"))


def orphans(edges: DataFrame, column: str, targets: DataFrame, constraint: str) -> DataFrame:
    """Edges whose end does not exist."""
    known = targets.select("tenant_id", F.col("id").alias(column))
    return (edges.join(known, ["tenant_id", column], "left_anti")
            .select("tenant_id", F.lit(constraint).alias("constraint"), F.col(column).alias("missing")))


def unmatched_statuses(statuses: DataFrame, transfers: DataFrame) -> DataFrame:
    """Status messages whose transfer has not arrived; they cannot be evaluated yet."""
    return statuses.join(transfers.select("tenant_id", "end_to_end_id"), ["tenant_id", "end_to_end_id"], "left_anti")

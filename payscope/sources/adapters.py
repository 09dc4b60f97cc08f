"""The common payment table ``pay``, built from stored tables.

``pay`` has one row per status message joined to its transfer: tenant_id, e2e, msg_id, dbtr_id, cdtr_id, dbtr_acct,
cdtr_acct, amt, ccy, req_ms (transfer time), t_ms (status time), ok (settled), descr, tx_kind, lat, lon, birth_date.
"""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import plain_unions
from .shared import staged

STATUS = "pacs.002.001.12"
TRANSFER = "pacs.008.001.10"
SETTLED = "ACCC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone since 1970-01-01, whatever the session zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    millis = F.floor(F.extract(F.lit("SECOND"), ts) * 1000)
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000 + seconds.cast("bigint") * 1000 + millis.cast("bigint")


def pay_from_events(events: DataFrame, *keep: str) -> DataFrame:
    """Payments from the event table: user pays the account in ``props.k``; debtors and creditors share accounts."""
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (F.when(F.col("event_type") == "purchase", "MP2B").when(F.col("event_type") == "click", "MP2P")
            .when(F.col("event_type") == "view", "CASH").otherwise("OTHER"))
    return events.select(
        *keep, F.concat(F.lit("tenant-00"), (1 + u % 2).cast("string")).alias("tenant_id"),
        e.alias("e2e"), F.concat(F.lit("S"), e.cast("string")).alias("msg_id"),
        F.floor(u / 3).cast("bigint").alias("dbtr_id"), F.floor(k / 3).cast("bigint").alias("cdtr_id"),
        u.alias("dbtr_acct"), k.alias("cdtr_acct"),
        F.col("value").cast("decimal(18,2)").alias("amt"), F.lit("USD").alias("ccy"),
        (wall_ms(F.col("ts")) - 1000 * (e % 5)).alias("req_ms"), wall_ms(F.col("ts")).alias("t_ms"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.col("event_type"), k.cast("string")).alias("descr"), kind.alias("tx_kind"),
        (-60 + (u * 7 + e * 13) % 120).cast("double").alias("lat"),
        (-180 + (u * 11 + e * 17) % 360).cast("double").alias("lon"),
        F.date_add(F.lit("1950-01-01").cast("date"), ((u * 397) % 23000).cast("int")).alias("birth_date"))


def pay(spark: SparkSession, sf_dir: str, since: int | None = None, before: int | None = None) -> DataFrame:
    """Payments with ``since <= t_ms < before``; the bounds are put on the stored ``ts``, so they reach the scan."""
    events = table(spark, sf_dir, "events")
    at = lambda ms: F.lit(str(datetime(1970, 1, 1) + timedelta(milliseconds=ms))).cast("timestamp_ntz")
    if since is not None:
        events = events.where(F.col("ts") >= at(since))
    if before is not None:
        events = events.where(F.col("ts") < at(before))
    return pay_from_events(events)


def pay_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pay``, written once: rules read it many times, and each reading of the events parses them anew."""
    return staged(pay(spark, sf_dir), "payments")


def pay_from_history(messages: DataFrame) -> DataFrame:
    """Payments from joined messages (see ``history.data_cache``): text ids, ISO times."""
    ms = lambda c: F.unix_millis(F.to_timestamp(c))
    return messages.withColumns({"req_ms": ms("req_dt_tm"), "t_ms": ms("cre_dt_tm")})


def message_documents(events: DataFrame, tx_tp: str) -> DataFrame:
    """ISO 20022 message texts of one type built from the event table, with faults for the intake checks.

    Every 97th transfer lacks its creditor account, every 101st message repeats the previous message id, every 103rd
    text is cut short and so is not JSON.
    """
    e = F.col("event_id")
    rows = pay_from_events(events, "event_id", "ts")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    late = tx_tp == STATUS
    at = F.col("ts") if late else F.col("ts") - F.make_dt_interval(secs=(e % 5).cast("decimal(18,6)"))
    mark = {STATUS: "S", TRANSFER: "T", "pain.001.001.11": "I", "pain.013.001.09": "A"}[tx_tp]
    number = F.when((e % 101 == 0) & (e > 0), e - 1).otherwise(e)
    head = F.struct(F.concat(F.lit(mark), number.cast("string")).alias("MsgId"),
                    F.date_format(at, iso).alias("CreDtTm"))
    end_to_end = F.concat(F.lit("E"), e.cast("string"))
    account = lambda c: F.struct(F.struct(F.array(F.struct(
        c.cast("string").alias("Id"))).alias("Othr")).alias("Id"))
    debtor = account(F.col("dbtr_acct"))
    creditor = F.when((e % 97 != 0) | (e == 0), account(F.col("cdtr_acct")))
    amount = F.struct(F.struct(F.col("amt").alias("Amt"), F.lit("USD").alias("Ccy")).alias("Amt"))
    pmt_id = F.struct(end_to_end.alias("EndToEndId"))
    if tx_tp == STATUS:
        status = F.when(F.col("ok"), SETTLED).otherwise("RJCT")
        body = F.struct(head.alias("GrpHdr"), F.struct(
            end_to_end.alias("OrgnlEndToEndId"), status.alias("TxSts")).alias("TxInfAndSts")).alias("FIToFIPmtSts")
    elif tx_tp == TRANSFER:
        body = F.struct(head.alias("GrpHdr"), F.struct(
            pmt_id.alias("PmtId"), amount["Amt"].alias("InstdAmt"), amount["Amt"].alias("IntrBkSttlmAmt"),
            F.lit(1).alias("XchgRate"), debtor.alias("DbtrAcct"), creditor.alias("CdtrAcct"))
            .alias("CdtTrfTxInf")).alias("FIToFICstmrCdtTrf")
    else:
        root = "CstmrCdtTrfInitn" if tx_tp == "pain.001.001.11" else "CdtrPmtActvtnReq"
        body = F.struct(head.alias("GrpHdr"), F.struct(debtor.alias("DbtrAcct"), F.struct(
            pmt_id.alias("PmtId"), amount.alias("Amt"), creditor.alias("CdtrAcct")).alias("CdtTrfTxInf"))
            .alias("PmtInf")).alias(root)
    text = F.to_json(F.struct(F.lit(tx_tp).alias("TxTp"), F.col("tenant_id").alias("TenantId"), body))
    cut = (e % 103 == 0) & (e > 0)
    return (rows.select(e.alias("seq"), cut.alias("_cut"), text.alias("text"))
            .select("seq", F.when(F.col("_cut"), F.expr("left(text, length(text) - 2)")).otherwise(F.col("text"))
                    .alias("document")))


def governed_edges(pay_rows: DataFrame) -> DataFrame:
    """Account and entity conditions: every tenth subject has one, with cycling roles' outcomes and expiry.

    Columns: tenant_id, role (debtor|creditor), subject_type (account|entity), source, destination (condition id),
    evt_tp, incptn_ms, xprtn_ms, outcome.
    """
    day, hour = 86_400_000, 3_600_000
    subjects = pay_rows.select("tenant_id", F.inline(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(kind).alias("subject_type"), F.col(c).alias("source"))
        for role, kind, c in (("debtor", "account", "dbtr_acct"), ("creditor", "account", "cdtr_acct"),
                              ("debtor", "entity", "dbtr_id"), ("creditor", "entity", "cdtr_id"))]))).distinct()
    s = F.col("source")
    begins = F.lit(1_704_412_800_000) + s * hour  # 2024-01-05
    outcomes = F.array(*[F.lit(x) for x in ("none", "override", "overridable-block", "non-overridable-block")])
    return subjects.where(s % 10 == 0).select(
        "tenant_id", "role", "subject_type", "source",
        F.concat_ws("-", F.lit("C"), "role", "subject_type", s.cast("string")).alias("destination"),
        F.array(F.lit(STATUS)).alias("evt_tp"), begins.alias("incptn_ms"),
        F.when(s % 20 != 0, begins + 7 * day).alias("xprtn_ms"),
        F.get(outcomes, (F.floor(s / 10) % 4).cast("int")).alias("outcome"))

"""Message intake: projection of JSON documents, checks, quarantine, de-duplication, payload mapping."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping as mapped_functions
from .shared import staged

PACS002, PACS008 = "pacs.002.001.12", "pacs.008.001.10"
PAIN001, PAIN013 = "pain.001.001.11", "pain.013.001.09"

_HEAD = "GrpHdr STRUCT<MsgId: STRING, CreDtTm: STRING>"
_ACCT = "STRUCT<Id: STRUCT<Othr: ARRAY<STRUCT<Id: STRING>>>>"
_AMT = "STRUCT<Amt: DECIMAL(18,2), Ccy: STRING>"
_PMT_INF = (f"PmtInf STRUCT<DbtrAcct: {_ACCT}, CdtTrfTxInf: STRUCT<PmtId: STRUCT<EndToEndId: STRING>, "
            f"CdtrAcct: {_ACCT}>>")

# Where each column lies in its document. {type: (schema of the document, {column: path})}
LAYOUT = {
    PACS002: (f"TenantId STRING, FIToFIPmtSts STRUCT<{_HEAD}, TxInfAndSts STRUCT<OrgnlEndToEndId: STRING, TxSts: STRING>>",
              {"cre_dt_tm": "FIToFIPmtSts.GrpHdr.CreDtTm", "message_id": "FIToFIPmtSts.GrpHdr.MsgId",
               "end_to_end_id": "FIToFIPmtSts.TxInfAndSts.OrgnlEndToEndId", "tx_sts": "FIToFIPmtSts.TxInfAndSts.TxSts",
               "tenant_id": "TenantId"}),
    PACS008: (f"TenantId STRING, FIToFICstmrCdtTrf STRUCT<{_HEAD}, CdtTrfTxInf STRUCT<PmtId: STRUCT<EndToEndId: STRING>, "
              f"InstdAmt: {_AMT}, IntrBkSttlmAmt: {_AMT}, XchgRate: DOUBLE, DbtrAcct: {_ACCT}, CdtrAcct: {_ACCT}>>",
              {"cre_dt_tm": "FIToFICstmrCdtTrf.GrpHdr.CreDtTm", "message_id": "FIToFICstmrCdtTrf.GrpHdr.MsgId",
               "end_to_end_id": "FIToFICstmrCdtTrf.CdtTrfTxInf.PmtId.EndToEndId",
               "debtor_account_id": "FIToFICstmrCdtTrf.CdtTrfTxInf.DbtrAcct.Id.Othr[0].Id",
               "creditor_account_id": "FIToFICstmrCdtTrf.CdtTrfTxInf.CdtrAcct.Id.Othr[0].Id", "tenant_id": "TenantId",
               "instd_amt": "FIToFICstmrCdtTrf.CdtTrfTxInf.InstdAmt.Amt",
               "intr_bk_sttlm_amt": "FIToFICstmrCdtTrf.CdtTrfTxInf.IntrBkSttlmAmt.Amt",
               "ccy": "FIToFICstmrCdtTrf.CdtTrfTxInf.InstdAmt.Ccy",
               "xchg_rate": "FIToFICstmrCdtTrf.CdtTrfTxInf.XchgRate"}),
    **{tx: (f"TenantId STRING, {root} STRUCT<{_HEAD}, {_PMT_INF}>",
            {"cre_dt_tm": f"{root}.GrpHdr.CreDtTm", "message_id": f"{root}.GrpHdr.MsgId",
             "end_to_end_id": f"{root}.PmtInf.CdtTrfTxInf.PmtId.EndToEndId",
             "debtor_account_id": f"{root}.PmtInf.DbtrAcct.Id.Othr[0].Id",
             "creditor_account_id": f"{root}.PmtInf.CdtTrfTxInf.CdtrAcct.Id.Othr[0].Id", "tenant_id": "TenantId"})
       for tx, root in ((PAIN001, "CstmrCdtTrfInitn"), (PAIN013, "CdtrPmtActvtnReq"))},
}
# Names of the stored tables' not-null constraints.
CONSTRAINTS = {"message_id": "message_id_not_null", "cre_dt_tm": "cre_dt_tm",
               "debtor_account_id": "dbtr_acct_id_not_null", "creditor_account_id": "cdtr_acct_id_not_null"}
KEY_FIELDS = ("end_to_end_id", "tenant_id")
MALFORMED = "malformed document"


def _path(root: str, path: str) -> Column:
    head, _, tail = path.partition("[0].")
    if not tail:
        return F.col(f"{root}.{path}")
    return F.get(F.col(f"{root}.{head}"), 0).getField(tail)


def extract(documents: DataFrame, tx_tp: str, keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns of every document of one type; the text is parsed once. Unparsable text gives nulls."""
    schema, paths = LAYOUT[tx_tp]
    # a one-element generator: filters on the columns stay above it, so no filter parses the text again
    doc = F.from_json("document", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    parsed = documents.select(*keep, "document", F.explode(F.array(doc)).alias("_doc"))
    bad = F.col("_doc").isNull() | F.col("_doc._bad").isNotNull()
    return parsed.select(*keep, "document", *[F.when(~bad, _path("_doc", p)).alias(c) for c, p in paths.items()],
                         bad.alias("malformed"))


# Flat documents, {column: (key, type)}.
TRANSACTION_FIELDS = {"end_to_end_id": ("EndToEndId", "string"), "amt": ("Amt", "decimal(18,2)"),
                      "ccy": ("Ccy", "string"), "msg_id": ("MsgId", "string"), "cre_dt_tm": ("CreDtTm", "string"),
                      "tx_tp": ("TxTp", "string"), "tx_sts": ("TxSts", "string"), "tenant_id": ("TenantId", "string")}
CONDITION_FIELDS = {"cond_id": ("condId", "string"), "tenant_id": ("tenantId", "string"),
                    "cre_dt_tm": ("creDtTm", "string"), "upd_dt_tm": ("updDtTm", "string")}


def extract_flat(documents: DataFrame, column: str, fields: Mapping[str, tuple[str, str]],
                 keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns of flat documents such as transaction edges and conditions."""
    schema = ", ".join(f"{key} {kind}" for key, kind in fields.values())
    parsed = documents.withColumn("_doc", F.from_json(column, schema))
    return parsed.select(*keep, *[F.col(f"_doc.{key}").alias(c) for c, (key, _) in fields.items()])


def validate(extracted: DataFrame) -> DataFrame:
    """Adds ``errors`` (failed constraints, in column order) and ``valid``."""
    tests = [F.when(F.col("malformed"), F.lit(MALFORMED))]
    for column, name in CONSTRAINTS.items():
        if column in extracted.columns:
            tests.append(F.when(~F.col("malformed") & F.col(column).isNull(), F.lit(name)))
    for column in KEY_FIELDS:
        tests.append(F.when(~F.col("malformed") & F.col(column).isNull(), F.lit(f"{column}_not_null")))
    errors = F.array_compact(F.array(*tests))
    return extracted.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def quarantine(validated: DataFrame, endpoint: str, config_id: str, version: str, created_at: Column,
               fallback_tenant: str = "DEFAULT") -> DataFrame:
    """The failed documents in the quarantine table's shape; ids derive from the content, so a retry repeats them."""
    digest = F.sha2(F.concat_ws("|", F.lit(endpoint), F.col("document")), 256)
    uid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return validated.where(~F.col("valid")).select(
        uid.alias("id"), F.col("message_id").alias("correlation_id"),
        F.coalesce("tenant_id", F.lit(fallback_tenant)).alias("tenant_id"), F.lit(endpoint).alias("endpoint_path"),
        F.lit(config_id).alias("config_id"), F.lit(version).alias("version"),
        F.concat_ws("; ", "errors").alias("error"), F.col("document").alias("raw_payload"),
        F.lit("quarantined").alias("status"), created_at.cast("timestamp_ntz").alias("created_at"))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``; an aggregation, so copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*rows.columns)


def dedup_message(rows: DataFrame, order: Sequence[str], extra_key: Sequence[str] = ()) -> DataFrame:
    """The rows that two unique keys, (message_id, tenant_id) and (end_to_end_id, [tx_tp,] tenant_id), accept in order.

    A row is refused if a kept row has one of its keys; a refused row blocks nobody. A key without its id clashes with
    none; equal rows are one. A row that comes first under both keys is kept and those that share a key with it are
    refused, which mostly settles all. What is left, chains of clashes, falls into connected pieces that are found in a
    number of passes that grows with the logarithm of the longest chain; each piece is then settled in order by one task,
    which holds the piece's keys. Passes are written to the shared folder.
    """
    given = F.struct(*order, *[c for c in rows.columns if c not in order])
    key = lambda name, own: F.when(F.col(own).isNotNull(), F.concat_ws(
        "|", F.lit(name), *[F.base64(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
                            for c in ("tenant_id", own, *(extra_key if name == "e" else ()))]))
    left = staged(rows.distinct().select(given.alias("_row"), key("m", "message_id").alias("_one"),
                                         key("e", "end_to_end_id").alias("_two")), "messages")

    def firsts(name: str) -> DataFrame:
        return left.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("_row").alias(f"_first{name}"))

    is_first = lambda name: F.col(name).isNull() | F.col("_row").eqNullSafe(F.col(f"_first{name}"))
    seen = left.join(firsts("_one"), "_one", "left").withColumn("_in_one", is_first("_one")).drop("_first_one")
    seen = seen.join(firsts("_two"), "_two", "left").select(
        "_row", "_one", "_two", (F.col("_in_one") & is_first("_two")).alias("_both"))
    seen = staged(seen, "settled")
    chosen, rest = seen.where("_both").drop("_both"), seen.where("not _both").drop("_both")
    if not rest.isEmpty():
        rest = staged(rest.join(chosen.select("_one"), "_one", "left_anti").join(chosen.select("_two"), "_two", "left_anti")
                      .select("_row", "_one", "_two"), "clashing")
    kept = chosen
    if not rest.isEmpty():
        pieces = connected(rest.where("_one is not null and _two is not null").select("_one", "_two"))
        placed = rest.join(pieces.withColumnRenamed("node", "_one"), "_one", "left").withColumn(
            "_piece", F.coalesce("least", "_one", "_two")).drop("least")
        kept = kept.unionByName(_settled(placed))
    return kept.select("_row.*").select(*rows.columns)


def _settled(placed: DataFrame) -> DataFrame:
    """Rows of each piece in order, those whose keys no kept row has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seen = None, set()
        for batch in batches:
            keep = []
            for at, *keys in zip(*(batch.column(c).to_pylist() for c in ("_piece", "_one", "_two"))):
                if at != piece:
                    piece, seen = at, set()
                free = not any(k in seen for k in keys)
                if free:
                    seen.update(k for k in keys if k is not None)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["_row", "_one", "_two"])

    ordered = placed.repartition("_piece").sortWithinPartitions("_piece", "_row")
    return ordered.mapInArrow(run, placed.select("_row", "_one", "_two").schema)


def connected(edges: DataFrame) -> DataFrame:
    """``node, least``: the least node that each node of an undirected graph (two text columns) is connected to.

    Edges are turned to point to smaller nodes, by turns of the greater and of the smaller neighbours, until they are
    stars; a path of n edges takes about log n turns.
    """
    one, two = edges.columns
    now = staged(edges.select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("least"))
            return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
        state = after


def map_payload(payloads: DataFrame, mapping: Mapping[str, dict], keep: Sequence[str] = ()) -> DataFrame:
    """Configured mapping of JSON payloads (column ``payload``) to the target model.

    ``mapping`` is {target: {"sources": [path, ...], "type": ddl, "constant": x, "delimiter": s, "functions": [...]}}: one
    source is cast to the type, several are joined as text, a constant needs no source. Configured functions take the
    sources as text, the first one all of them, each next one the result before (``functions/mapping.py``). Payloads that
    are not JSON give nulls.
    """
    parsed = payloads.withColumn("_v", F.try_parse_json("payload"))
    return parsed.select(*keep, *[_mapped(spec, lambda p, t: F.try_variant_get("_v", p, t)).alias(target)
                                  for target, spec in mapping.items()])


def map_payload_xml(payloads: DataFrame, schema: str, mapping: Mapping[str, dict], keep: Sequence[str] = ()) -> DataFrame:
    """The same for XML payloads; ``schema`` is the DDL of the payload's root element, paths are dotted fields."""
    parsed = payloads.withColumn("_x", F.from_xml("payload", schema))
    return parsed.select(*keep, *[_mapped(spec, lambda p, t: F.col(f"_x.{p}").cast(t)).alias(target)
                                  for target, spec in mapping.items()])


def _mapped(spec: Mapping, get) -> Column:
    kind = spec.get("type", "string")
    if "constant" in spec:
        return F.lit(spec["constant"]).cast(kind)
    sources = spec["sources"]
    if spec.get("functions"):
        return mapped_functions.apply([get(s, "string") for s in sources], spec["functions"]).cast(kind)
    if len(sources) == 1:
        return get(sources[0], kind)
    return F.concat_ws(spec.get("delimiter", ""), *[get(s, "string") for s in sources]).cast(kind)

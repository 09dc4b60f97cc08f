"""From a rule's value to its outcome: exit conditions, bands, cases, configuration checks.

A value, rounded to 6 decimals (ours: statistics are doubles), falls in the first band with ``lower <= value < upper``; a missing limit is open. An exit outranks the band.
Anything else is ``.err``. Evidence: limits and texts are configuration; the band reading is half-open because
neighbouring bands share a limit.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERR = ".err"
JUDGED = "_judged"  # where payments have this column, only those that it names get results
# Messages raised for unusable configurations and histories.
UNHANDLED = "Unhandled rule result outcome"
NO_BANDS = "Invalid config provided - bands not provided"
NO_EXITS = "Invalid config provided - exitConditions not provided"
BAD_TOLERANCE = "Invalid config provided - tolerance parameter not provided or invalid type"
NO_X00 = "Unsuccessful transaction and no exit condition in config"
NO_X01 = "Insufficient History and no exit condition in config"
NO_HISTORY = "Data error: irretrievable transaction history"
NOT_NUMERIC = "Data error: query result type mismatch - expected [numbers]"


def validate_rule_config(doc: Mapping, numeric: tuple[str, ...] = ()) -> None:
    """Raise ``ValueError`` when the document lacks bands, exits or a numeric parameter named in ``numeric``."""
    config = doc.get("config") or {}
    if not config.get("bands") and not config.get("cases"):
        raise ValueError(NO_BANDS)
    if config.get("exitConditions") is None:
        raise ValueError(NO_EXITS)
    for name in numeric:
        value = (config.get("parameters") or {}).get(name)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(BAD_TOLERANCE if name == "tolerance" else
                             f"Invalid config provided - {name} parameter not provided or invalid type")


def rule_document_faults(documents: DataFrame, column: str = "configuration", numeric: tuple[str, ...] = ()) -> DataFrame:
    """Stored rule documents (JSON in ``column``) with ``error``, the first fault that ``validate_rule_config`` raises;
    null for a usable document. A document that is no JSON lacks everything."""
    doc = F.try_parse_json(column)
    listed = F.coalesce(F.size(F.try_variant_get(doc, "$.config.bands", "array<variant>")), F.lit(0)) > 0
    cases = F.try_variant_get(doc, "$.config.cases", "variant").isNotNull()
    exits = F.coalesce(F.schema_of_variant(F.try_variant_get(doc, "$.config.exitConditions", "variant")), F.lit("VOID"))
    error = F.when(~listed & ~cases, F.lit(NO_BANDS)).when(exits == "VOID", F.lit(NO_EXITS))
    for name in numeric:
        kind = F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.config.parameters.{name}", "variant")), F.lit("VOID"))
        error = error.when(~kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(
            BAD_TOLERANCE if name == "tolerance" else f"Invalid config provided - {name} parameter not provided or invalid type"))
    return documents.withColumn("error", error)


def exit_refs(doc: Mapping) -> dict[str, str]:
    return {e["subRuleRef"]: e["reason"] for e in doc["config"].get("exitConditions") or []}


def determine_outcome_band(value: Column, bands: list[dict]) -> Column:
    """The reference of the first band holding ``value``; null when none does."""
    out = F.lit(None).cast("string")
    for band in reversed(bands):
        hit = value.isNotNull()
        if band.get("lowerLimit") is not None:
            hit = hit & (value >= F.lit(band["lowerLimit"]))
        if band.get("upperLimit") is not None:
            hit = hit & (value < F.lit(band["upperLimit"]))
        out = F.when(hit, F.lit(band["subRuleRef"])).otherwise(out)
    return out


def determine_outcome_case(value: Column, cases: Mapping) -> Column:
    """The reference of the case equal to ``value``, else the alternative; null only for a null value."""
    out = F.lit(cases["alternative"]["subRuleRef"])
    for case in reversed(cases["expressions"]):
        out = F.when(value == F.lit(case["value"]), F.lit(case["subRuleRef"])).otherwise(out)
    return F.when(value.isNotNull(), out)


def reasons(doc: Mapping) -> dict[str, str]:
    config = doc["config"]
    out = {ERR: UNHANDLED, **exit_refs(doc)}
    for band in config.get("bands") or []:
        out[band["subRuleRef"]] = band["reason"]
    if config.get("cases"):
        out.update({c["subRuleRef"]: c["reason"] for c in config["cases"]["expressions"]})
        out[config["cases"]["alternative"]["subRuleRef"]] = config["cases"]["alternative"]["reason"]
    return out


def outcome(doc: Mapping, value: Column, leaves: Column | None = None, error: Column | None = None) -> tuple:
    """One rule's raw answer for one event: its value and, if the history calls for them, an exit or a data error."""
    cells = {"_exit": leaves, "_error": error}
    if doc["config"].get("cases"):
        cells["_case"] = value.cast("string")
    else:
        cells["_number"] = F.round(value.cast("double"), 6)
    return doc, {k: c for k, c in cells.items() if c is not None}


_CELLS = {"_number": "double", "_case": "string", "_exit": "string", "_error": "string"}


def _per_rule(docs: list[Mapping], build, kind: str) -> Column:
    """What ``build`` says of the current row's rule: a constant array indexed by ``_rule``."""
    return F.get(F.array(*[F.lit(None).cast(kind) if (x := build(d)) is None else x.cast(kind) for d in docs]), F.col("_rule"))


def _constant_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else None


def results(wide: DataFrame, answers: list[tuple]) -> DataFrame:
    """One row per event and rule (tenant_id, e2e, rule_id, cfg, value, sub_rule_ref, reason); narrow, no shuffle.

    Answers are unfolded to narrow rows first and decided afterwards by looking limits and texts up in constant
    arrays. The decision's code is then the same few expressions for any number of rules.
    """
    docs = [doc for doc, _ in answers]
    if JUDGED in wide.columns:
        wide = wide.where(JUDGED)
    # statistics become columns of their own first, so that the code unfolding them stays small
    flat = wide.select("tenant_id", "e2e", "ok", *[
        c.cast(_CELLS[k]).alias(f"{k}_{i}") for i, (_, cells) in enumerate(answers) for k, c in cells.items()])
    raw = flat.select("tenant_id", "e2e", "ok", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_rule"), *[(F.col(f"{k}_{i}") if k in cells else F.lit(None).cast(kind)).alias(k)
                                            for k, kind in _CELLS.items()])
        for i, (_, cells) in enumerate(answers)])))

    def bands(doc):
        listed = doc["config"].get("bands")
        return listed and F.array(*[F.struct(
            F.lit(b.get("lowerLimit")).cast("double").alias("lo"), F.lit(b.get("upperLimit")).cast("double").alias("hi"),
            F.lit(b["subRuleRef"]).alias("ref")) for b in listed])

    def cases(doc):
        listed = doc["config"].get("cases")
        return listed and _constant_map({c["value"]: c["subRuleRef"] for c in listed["expressions"]})

    def alternative(doc):
        listed = doc["config"].get("cases")
        return F.lit(listed["alternative"]["subRuleRef"]) if listed else None

    value, ok = F.col("_number"), F.col("ok")
    inside = F.filter(_per_rule(docs, bands, "array<struct<lo:double,hi:double,ref:string>>"), lambda b: (
        b["lo"].isNull() | (value >= b["lo"])) & (b["hi"].isNull() | (value < b["hi"])))
    picked = F.when(value.isNotNull(), F.get(inside, 0)["ref"])
    if any(d["config"].get("cases") for d in docs):
        by_case = F.coalesce(_per_rule(docs, cases, "map<string,string>")[F.col("_case")],
                             _per_rule(docs, alternative, "string"))
        picked = F.when(F.col("_case").isNotNull(), by_case).otherwise(picked)
    held = _per_rule(docs, lambda d: F.array(*[F.lit(r) for r in exit_refs(d)]), "array<string>")
    failed = ~ok & F.array_contains(held, ".x00")
    lacking = F.when(F.col("_exit") == ".x01", F.lit(NO_X01)).otherwise(F.lit(UNHANDLED))
    fault = F.when(~failed, F.coalesce("_error", F.when(~F.array_contains(held, F.col("_exit")), lacking)))
    decided = raw.select("tenant_id", "e2e", "_rule", "_number", picked.alias("_picked"), fault.alias("_fault"),
                         F.when(failed, F.lit(".x00")).otherwise(F.col("_exit")).alias("_left"))
    ref = F.when(F.col("_fault").isNotNull(), F.lit(ERR)).otherwise(F.coalesce("_left", "_picked", F.lit(ERR)))
    plain = F.col("_fault").isNull() & F.col("_left").isNull()
    named = decided.select("tenant_id", "e2e", "_rule", F.when(plain, F.col("_number")).alias("value"),
                           ref.alias("sub_rule_ref"), "_fault")
    text = _per_rule(docs, lambda d: _constant_map(reasons(d)), "map<string,string>")[F.col("sub_rule_ref")]
    return named.select("tenant_id", "e2e",
                        _per_rule(docs, lambda d: F.lit(d["id"].split("@")[0]), "string").alias("rule_id"),
                        _per_rule(docs, lambda d: F.lit(d["cfg"]), "string").alias("cfg"), "value", "sub_rule_ref",
                        F.coalesce("_fault", text).alias("reason"))

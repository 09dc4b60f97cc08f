"""The rule catalogue: parameters, exit conditions, bands and cases per rule.

``rule_config`` expands a catalogue entry to the configuration document shape
(id, cfg, tenantId, desc, config{parameters, exitConditions, bands | cases}).
"""
from __future__ import annotations

DAY = 86400000

# Rule ids, parameters, exit texts, limits and outcome texts must equal the published configuration.
# Entry: description, parameters, exits {ref: reason}, bands [(ref, lower, upper, reason)].
RULES: dict[str, tuple] = {
    "001": ("Derived account age - creditor", {},
            {".x01": "No verifiable creditor account activity detected"},
            [(".01", None, 86400000, "Creditor account is less than 1 day old"),
             (".02", 86400000, None, "Creditor account is more than 1 day old")]),
    "002": ("Transaction convergence - debtor", {"maxQueryRange": 86400000}, {},
            [(".01", None, 5, "No transaction convergence detected on debtor account"),
             (".02", 5, None, "Transaction convergence detected on debtor account")]),
    "003": ("Account dormancy - creditor", {},
            {".x01": "No verifiable creditor account activity detected"},
            [(".01", None, 7889229000, "Creditor account not dormant in the last 3 months"),
             (".02", 7889229000, None, "Creditor account dormant for more than 3 months")]),
    "004": ("Account dormancy - debtor", {},
            {".x01": "No verifiable debtor account activity detected"},
            [(".01", None, 7889229000, "Debtor account not dormant in the last 3 months"),
             (".02", 7889229000, None, "Debtor account dormant for more than 12 months")]),
    "006": ("Outgoing transfer similarity - amounts", {"maxQueryLimit": 3, "tolerance": 0.1},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "Insufficient transaction history"},
            [(".01", None, 2, "No similar amounts detected in the most recent transactions from the debtor"),
             (".02", 2, None, "Two or more similar amounts detected in the most recent transactions from the debtor")]),
    "007": ("Outgoing transfer similarity - descriptions", {},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history"},
            [(".01", 0, 1, "Identical descriptions for consecutive successful transactions"),
             (".02", 1, 5, "Similar descriptions for consecutive successful transactions"),
             (".03", 5, None, "Significantly different descriptions for consecutive successful transactions")]),
    "008": ("Outgoing transfer similarity - creditor", {"maxQueryLimit": 3},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history"},
            [(".01", None, 2, "No recent transactions to the same creditor account"),
             (".02", 2, None, "Two or more recent transactions to the same creditor account")]),
    "010": ("Increased account activity: volume - debtor", {"evaluationIntervalTime": 86400000},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "Insufficient transaction history",
             ".x03": "No variance in transaction history and the volume of recent incoming transactions shows an increase for the debtor",
             ".x04": "No variance in transaction history and the volume of recent incoming transactions is less than or equal to the historical average for the debtor"},
            [(".01", None, 3, "The volume of recent outgoing transactions is within acceptable limits for the debtor"),
             (".02", 3, None, "The volume of recent outgoing transactions shows a significant increase for the debtor")]),
    "011": ("Increased account activity: volume - creditor", {"evaluationIntervalTime": 86400000},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "Insufficient transaction history",
             ".x03": "No variance in transaction history and the volume of recent incoming transactions shows an increase for the creditor",
             ".x04": "No variance in transaction history and the volume of recent incoming transactions is less than or equal to the historical average for the creditor"},
            [(".01", None, 3, "The volume of recent incoming transactions is within acceptable limits for the creditor"),
             (".02", 3, None, "The volume of recent incoming transactions shows a significant increase for the creditor")]),
    "016": ("Transaction convergence - creditor", {"maxQueryRange": 86400000}, {},
            [(".01", None, 5, "No Transaction convergence detected on creditor account"),
             (".02", 5, None, "Transaction convergence detected on creditor account")]),
    "017": ("Transaction divergence - debtor", {"maxQueryRange": 28800000}, {},
            [(".01", None, 5, "No Transaction divergence detected on source account"),
             (".02", 5, None, "Transaction divergence detected on source account")]),
    "018": ("Exceptionally large outgoing transfer - debtor", {"maxQueryRange": 7889229000},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "Insufficient transaction history"},
            [(".01", None, 1.5, "Outgoing transfer within historical limits"),
             (".02", 1.5, None, "Exceptionally large outgoing transfer detected")]),
    "020": ("Large transaction amount vs history - creditor", {},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "Insufficient transaction history",
             ".x03": "No variance in transaction history and the amount of the incoming transactions shows an increase for the creditor",
             ".x04": "No variance in transaction history and the amount of the incoming transactions is less than or equal to the historical average for the creditor"},
            [(".01", None, 3, "The amount of the incoming transaction is within acceptable limits for the creditor"),
             (".02", 3, None, "The amount of the incoming transaction shows a significant increase for the creditor")]),
    "021": ("A large number of similar transaction amounts - creditor", {"maxQueryRange": 86400000, "tolerance": 0.1},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history"},
            [(".01", None, 5, "The creditor has received an insignificant number of transactions with the same amount in the last 24 hours"),
             (".02", 5, None, "The creditor has received a significant number of transactions with the same amount in the last 24 hours")]),
    "024": ("Non-commissioned transaction mirroring - creditor", {"maxQueryRange": 86400000, "tolerance": 0.1},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history",
             ".x03": "No non-commissioned transaction mirroring detected"},
            [(".01", None, 2, "Immediate non-commissioned transaction mirroring detected"),
             (".02", 2, None, "Aggregated non-commissioned transaction mirroring detected")]),
    "025": ("Non-commissioned transaction mirroring - debtor", {"maxQueryRange": 86400000, "tolerance": 0.1},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history",
             ".x03": "No non-commissioned transaction mirroring detected"},
            [(".01", None, 2, "Immediate non-commissioned transaction mirroring detected"),
             (".02", 2, None, "Aggregated non-commissioned transaction mirroring detected")]),
    "026": ("Commissioned transaction mirroring - creditor",
            {"maxQueryRange": 86400000, "commission": 0.1, "tolerance": 0.1},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history",
             ".x03": "No commissioned transaction mirroring detected"},
            [(".01", None, 2, "Immediate commissioned transaction mirroring detected"),
             (".02", 2, None, "Aggregated commissioned transaction mirroring detected")]),
    "027": ("Commissioned transaction mirroring - debtor",
            {"maxQueryRange": 86400000, "commission": 0.1, "tolerance": 0.1},
            {".x00": "Unsuccessful transaction", ".x01": "Insufficient transaction history",
             ".x03": "No commissioned transaction mirroring detected"},
            [(".01", None, 2, "Immediate commissioned transaction mirroring detected"),
             (".02", 2, None, "Aggregated commissioned transaction mirroring detected")]),
    "028": ("Age classification - debtor", {}, {},
            [(".01", 0, 18, "The debtor is younger than 18 years old"),
             (".02", 18, None, "The debtor is 30 years or older")]),
    "030": ("Transfer to unfamiliar creditor account - debtor", {}, {".x00": "Unsuccessful transaction"},
            [(".01", None, 2, "First successful payment from this debtor to creditor account"),
             (".02", 2, None, "Second or more successful payment from this debtor to creditor account")]),
    "044": ("Successful transactions from the debtor, including the new transaction", {}, {},
            [(".01", None, 1, "To date, no successful payments have been made from debtor account"),
             (".02", 1, 2, "To date, one successful payment has been made from debtor account"),
             (".03", 2, None, "To date, two or more successful payments have been made from debtor account")]),
    "045": ("Successful transactions to the creditor, including the new transaction", {}, {},
            [(".01", None, 1, "To date, no successful payments have been made to creditor account"),
             (".02", 1, 2, "To date, one successful payment has been made to creditor account"),
             (".03", 2, None, "To date, two or more successful payments have been made to creditor account")]),
    "048": ("Large transaction amount vs history - debtor", {},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "Insufficient transaction history",
             ".x03": "No variance in transaction history and the amount of the incoming transactions shows an increase for the debtor",
             ".x04": "No variance in transaction history and the amount of the incoming transactions is less than or equal to the historical average for the debtor"},
            [(".01", None, 3, "The amount of the outgoing transaction is within acceptable limits for the debtor"),
             (".02", 3, None, "The amount of the outgoing transaction shows a significant increase for the debtor")]),
    "054": ("Synthetic data check - Benford's Law - debtor", {"minimumNumberOfTransactions": 50},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "At least 50 historical transactions required"},
            [(".01", None, 15.507, "Benfords Law: Debtor transaction history indicates a low probability of fictitious amounts"),
             (".02", 15.507, None, "Benfords Law: Debtor transaction history indicates a high probability of fictitious amounts")]),
    "063": ("Synthetic data check - Benford's Law - creditor", {"minimumNumberOfTransactions": 50},
            {".x00": "Incoming transaction is unsuccessful", ".x01": "At least 50 historical transactions required"},
            [(".01", None, 15.507, "Benfords Law: Creditor transaction history indicates a low probability of fictitious amounts"),
             (".02", 15.507, None, "Benfords Law: Creditor transaction history indicates a high probability of fictitious amounts")]),
    "074": ("Distance over time from last transaction location - debtor", {"maxQueryRange": 3600000},
            {".x01": "Insufficient transaction history"},
            [(".01", None, 50, "Reasonable walking speed"),
             (".02", 50, None, "Ludicrous speed")]),
    "075": ("Distance from habitual locations - debtor", {"maxRadius": 5.0},
            {".x01": "Insufficient transaction history"},
            [(".01", None, 1, "The debtor has never transacted within 5km of this location"),
             (".02", 1, 5, "The debtor has very few prior transactions within 5km of this location"),
             (".03", 5, None, "The debtor frequently transacts near this location")]),
    "076": ("Time since last transaction - debtor", {},
            {".x01": "Insufficient transaction history"},
            [(".01", None, 300000, "Suspiciously quick follow-up transaction"),
             (".02", 300000, None, "Follow-up transaction speed within acceptable limits")]),
    "083": ("Multiple accounts associated with a debtor", {}, {},
            [(".01", None, 2, "Debtor has only one account"),
             (".02", 2, None, "Debtor has more one account")]),
    "084": ("Multiple accounts associated with a creditor", {}, {},
            [(".01", None, 2, "Creditor has only one account"),
             (".02", 2, None, "Creditor has more one account")]),
    "090": ("Upstream transaction divergence - debtor",
            {"maxQueryRangeUpstream": 86400000, "maxQueryRangeDownstream": 86400000}, {},
            [(".01", None, 3, "Upstream transaction divergence within acceptable limits"),
             (".02", 3, None, "Upstream transaction divergence detected")]),
    "091": ("Transaction amount vs regulatory threshold", {}, {},
            [(".01", None, 10000, "Transaction amount within regulatory limits"),
             (".02", 10000, None, "Transaction amount exceeds regulatory threshold")]),
    "901": ("Number of outgoing transactions - debtor", {"maxQueryRange": 86400000},
            {".x00": "Incoming transaction is unsuccessful"},
            [(".01", None, 2, "The debtor has performed one transaction in the last day"),
             (".02", 2, 3, "The debtor has performed two transactions in the last day"),
             (".03", 3, None, "The debtor has performed three or more transactions in the last day")]),
    "902": ("Number of incoming transactions - creditor", {"maxQueryRange": 86400000},
            {".x00": "Incoming transaction is unsuccessful"},
            [(".01", None, 2, "The creditor has received one transaction in the last day"),
             (".02", 2, 3, "The creditor has received two transactions in the last day"),
             (".03", 3, None, "The creditor has received three or more transactions in the last day")]),
}

# Rule 078 chooses by case. Cases (ref, value, reason), then the alternative (ref, reason).
TRANSACTION_TYPE = (
    "Transaction type",
    [(".01", "MP2B", "The transaction is identified as a Mobile P2B Payment"),
     (".02", "MP2P", "The transaction is identified as a Mobile P2P Payment"),
     (".03", "CASH", "The transaction is identified as a general cash management instruction")],
    (".00", "The transaction type is not defined in this rule configuration"),
)

# Event-flow outcomes; the last two are the block kinds named by the typology weights.
EVENT_FLOW = {
    "none": "No entity or account condition in effect",
    "override": "An entity or account override condition is in effect",
    "overridable-block": "An entity or account block condition is in effect",
    "non-overridable-block": "An entity or account block condition is in effect",
}

# The two example tenants word the count outcomes "to date".
TENANTS = ("tenant-001", "tenant-002")
TENANT_WORDING = ("in the last day", "to date")

ALL_RULES = sorted([*RULES, "078"])
FULL_SET = [r for r in ALL_RULES if r not in ("901", "902")]


def rule_config(rule: str, cfg: str = "4.0.0", tenant: str = "DEFAULT", **parameters) -> dict:
    """The configuration document of one rule; keyword arguments replace single parameters."""
    doc = {"id": f"{rule}@{cfg}", "cfg": cfg, "tenantId": tenant,
           "creDtTm": "2026-07-20T00:00:00.000Z", "updDtTm": "2026-07-20T00:00:00.000Z"}
    if rule == "078":
        desc, cases, (alt_ref, alt_reason) = TRANSACTION_TYPE
        doc["desc"] = desc
        doc["config"] = {
            "parameters": dict(parameters), "exitConditions": [],
            "cases": {"expressions": [{"subRuleRef": r, "value": v, "reason": t} for r, v, t in cases],
                      "alternative": {"subRuleRef": alt_ref, "reason": alt_reason}}}
        return doc
    desc, params, exits, bands = RULES[rule]
    doc["desc"] = desc
    doc["config"] = {
        "parameters": {**params, **parameters},
        "exitConditions": [{"subRuleRef": r, "reason": t} for r, t in exits.items()],
        "bands": [{k: v for k, v in (("subRuleRef", r), ("lowerLimit", lo), ("upperLimit", hi), ("reason", t))
                   if v is not None} for r, lo, hi, t in bands]}
    return doc


def tenant_rule_configs() -> list[dict]:
    """Rules 901 and 902 once per example tenant, with that file's wording."""
    docs = []
    for tenant in TENANTS:
        for rule in ("901", "902"):
            doc = rule_config(rule, tenant=tenant)
            for band in doc["config"]["bands"]:
                band["reason"] = band["reason"].replace(*TENANT_WORDING)
            docs.append(doc)
    return docs

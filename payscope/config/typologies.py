"""Typology (weighted score) and network map (routing) documents, built from weight rules."""
from __future__ import annotations

from .rules import ALL_RULES, FULL_SET, RULES, TENANTS, TRANSACTION_TYPE

EVENT_FLOW_RULE = {"id": "EFRuP@4.0.0", "cfg": "none"}

# Non-zero weights of the complete typology; every outcome not named weighs 0.
FULL_WEIGHTS = [
    (("001", "003", "004", "021", "028", "074", "083", "084", "091"), {".02": 100}),
    (("002", "006", "008", "016", "017", "018", "054", "063"), {".02": 200}),
    (("007",), {".01": 400, ".02": 200}),
    (("010", "011", "020", "048"), {".02": 200, ".x03": 100}),
    (("024", "025", "026", "027"), {".01": 200, ".02": 400}),
    (("030", "075", "076", "078"), {".01": 200, ".02": 100}),
    (("044", "045"), {".02": 200, ".03": 100}),
    (("090",), {".02": 400}),
]
# Weights of the two public count rules.
COUNT_WEIGHTS = {".err": "0", ".x00": "100", ".01": "100", ".02": "200", ".03": "400"}
FLOW_OUTCOMES = (".err", "override", "non-overridable-block", "overridable-block", "none")


def _outcomes(rule: str) -> list[str]:
    if rule == "078":
        return [".err", TRANSACTION_TYPE[2][0], *[c[0] for c in TRANSACTION_TYPE[1]]]
    _, _, exits, bands = RULES[rule]
    return [".err", *exits, *[b[0] for b in bands]]


# Term ids, and the one of the event-flow rule below, follow the published form.
def term(rule: str, cfg: str = "4.0.0") -> str:
    at = "at" + cfg.replace(".", "")
    return f"v{rule}{at}{at}"


def _entry(rule: str, weights: dict) -> dict:
    return {"id": f"{rule}@4.0.0", "cfg": "4.0.0", "termId": term(rule),
            "wghts": [{"ref": r, "wght": weights.get(r, 0)} for r in _outcomes(rule)]}


def _typology(cfg: str, entries: list[dict], alert: int, interdict: int, tenant: str = "DEFAULT") -> dict:
    flow = {**EVENT_FLOW_RULE, "termId": "vEFRuPat400atnone",
            "wghts": [{"ref": r, "wght": 0} for r in FLOW_OUTCOMES]}
    return {"id": "typology-processor", "cfg": cfg, "tenantId": tenant,
            "workflow": {"alertThreshold": alert, "interdictionThreshold": interdict,
                         "flowProcessor": EVENT_FLOW_RULE["id"]},
            "rules": [*entries, flow], "expression": ["Add", *[e["termId"] for e in entries]]}


def _full_entries() -> list[dict]:
    weights = {rule: w for rules, w in FULL_WEIGHTS for rule in rules}
    return [_entry(rule, weights[rule]) for rule in FULL_SET]


def typology_999(tenant: str = "DEFAULT", cfg: str = "999-901-902@4.0.0") -> dict:
    return _typology(cfg, [_entry("901", COUNT_WEIGHTS), _entry("902", COUNT_WEIGHTS)], 300, 500, tenant)


# Thresholds (alert, interdiction) per typology.
TYPOLOGIES = {
    "999-901": _typology("999-901@4.0.0", [_entry("901", COUNT_WEIGHTS)], 200, 400),
    "999-901-902": typology_999(),
    "000": _typology("000@4.0.0", _full_entries(), 2200, 2600),
}


def network_map(tenant: str, typologies: list[dict], cfg: str = "4.0.0", active: bool = True,
                tx_tp: str = "pacs.002.001.12") -> dict:
    return {"active": active, "cfg": cfg, "tenantId": tenant,
            "messages": [{"id": "004@4.0.0", "cfg": "4.0.0", "txTp": tx_tp, "typologies": [
                {"id": t["id"], "cfg": t["cfg"],
                 "rules": [{"id": r["id"], "cfg": r["cfg"]} for r in t["rules"]]} for t in typologies]}]}


def tenant_typologies() -> list[dict]:
    """One count typology per example tenant."""
    return [typology_999(tenant, "999@4.0.0") for tenant in TENANTS]


NETWORK_MAPS = {
    "public": network_map("DEFAULT", [TYPOLOGIES["999-901"]]),
    "hub": network_map("DEFAULT", [TYPOLOGIES["999-901-902"]]),
    "full": network_map("DEFAULT", [TYPOLOGIES["000"]]),
    "tenants": [network_map(t["tenantId"], [t]) for t in tenant_typologies()],
}
RULE_IDS = ALL_RULES

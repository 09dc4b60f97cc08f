"""Which function answers which rules, and the evaluation of a set of rule configurations over a payment history."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial, reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config.rules import rule_config
from ...sources.shared import staged, together
from ..outcome import outcome, results
from . import account, lists, places, upstream

if TYPE_CHECKING:
    from ..kept import Kept

Family = Callable[..., DataFrame]

#: Those that store one partial result after another come first: their many small jobs then run beside the large ones.
FAMILIES: list[tuple[tuple[str, ...], Family]] = [
    (("090",), upstream.divergence),
    (account.CREDITOR_RULES, account.creditor),
    (("075",), places.habitual),
    (("021",), lists.similar_amounts),
    (account.DEBTOR_RULES, account.debtor),
    (("024", "026"), lists.mirror_creditor),
    (("025", "027"), lists.mirror_debtor),
    (("083", "084"), account.holders),
    (("006", "008"), lists.last_n),
    (("018",), lists.largest),
    (("030",), account.pair),
    (("028", "078", "091"), account.row_local),
]
#: Families that add kept totals to the payments they see; all others look back over a bounded range, or not at all.
KEEPERS = {account.debtor, account.creditor, account.pair, account.holders, lists.last_n, lists.largest, places.habitual}
#: Families with the most shuffled bytes for a payment.
HEAVY = {account.debtor, account.creditor, lists.similar_amounts}
_PLUGINS: dict[str, Family] = {}


def register_rule(rule: str, value: Callable[[DataFrame, dict], DataFrame]) -> None:
    """Add a rule: ``value(pay, config)`` returns (tenant_id, e2e, value) and may leave out events (``.err``).

    The value may come from columns, a window, a join or a pandas UDF; exits and bands are applied here.
    """
    def family(pay: DataFrame, docs: Mapping[str, dict]) -> DataFrame:
        doc = docs[rule]
        wide = pay.join(value(pay, doc).select("tenant_id", "e2e", "value"), ["tenant_id", "e2e"], "left")
        return results(wide, [outcome(doc, F.col("value"))])
    _PLUGINS[rule] = family


def evaluate_rules(pay: DataFrame, docs: Iterable[dict], kept: "Kept | None" = None, store: bool = False,
                   apart: bool = False) -> DataFrame:
    """Rule results (tenant_id, e2e, rule_id, cfg, value, sub_rule_ref, reason) for every payment and configuration.

    With ``kept`` totals, ``pay`` has a column ``carried``: payments that the totals hold already, which only rules with
    a look-back still read; their own results are void. A boolean column ``outcome.JUDGED`` tells which payments get results.

    With ``store``, each family writes its results as soon as it is planned and drops its shuffle files with that; one
    plan of all families would hold the shuffle files of all until its end, and plan itself anew after each of its stages.
    ``apart`` lets the families that shuffle most (``HEAVY``) write one after another, beside the others: on a large history
    that spares disk, on a small one it costs time, as the cores wait while one family is planned.

    Documents may have ``validFrom``: then each payment is judged by the version in force at its time, not by the latest.

    Rules that read the same time line share one scan; families are independent and joined by union. Several
    configurations of one rule all give results; the same one twice is refused.
    """
    docs = list(docs)
    if any("validFrom" in d for d in docs):
        return _by_time(pay, docs, kept, store, apart)
    rounds: list[dict[str, dict]] = []
    for doc in docs:
        rule = doc["id"].split("@")[0]
        if any(r.get(rule, {}).get("cfg") == doc["cfg"] for r in rounds):
            raise ValueError(f"configuration {doc['cfg']} of rule {rule} is given twice")
        free = next((r for r in rounds if rule not in r), None)
        if free is None:
            rounds.append(free := {})
        free[rule] = doc
    steps, heavy = [], []
    for by_rule in rounds:
        account.checked(by_rule)
        left = set(by_rule)
        for rules, family in [*FAMILIES, *[((r,), f) for r, f in _PLUGINS.items()]]:
            chosen = {r: by_rule[r] for r in rules if r in left}
            if chosen:
                step = partial(family, pay, chosen, *([kept] if kept is not None and family in KEEPERS else []))
                (heavy if apart and family in HEAVY else steps).append(partial(_stored, step) if store else step)
                left -= set(chosen)
        if left:
            raise ValueError(f"no implementation for rules {sorted(left)}")
    if heavy:
        steps.insert(0, lambda: reduce(DataFrame.unionByName, [step() for step in heavy]))
    return reduce(DataFrame.unionByName, together(pay.sparkSession, steps))  # several families store partial results when they are built


def _stored(step: Callable[[], DataFrame]) -> DataFrame:
    return staged(step(), "results")


def in_force(docs: Iterable[dict]) -> list[tuple[int | None, int | None, list[dict]]]:
    """Stretches of time [from, to) with the documents in force; of one id and cfg the last to begin holds. A document
    without ``validFrom`` (ms) has always held."""
    docs = list(docs)
    edges = sorted({d["validFrom"] for d in docs if d.get("validFrom") is not None})
    out = []
    for lo, hi in zip([None, *edges], [*edges, None]):
        held: dict[tuple[str, str], dict] = {}
        for d in sorted(docs, key=lambda d: (d.get("validFrom") is not None, d.get("validFrom") or 0)):
            begins = d.get("validFrom")
            if begins is None or (lo is not None and begins <= lo):
                held[d["id"], d["cfg"]] = {k: v for k, v in d.items() if k != "validFrom"}
        if held:
            out.append((lo, hi, list(held.values())))
    return out


def _by_time(pay: DataFrame, docs: Iterable[dict], kept: "Kept | None", store: bool, apart: bool) -> DataFrame:
    """Each payment by the documents in force at its time, over the history of all times. A payment before the first
    version of a document has no result for it."""
    parts = []
    for lo, hi, held in in_force(docs):
        inside = F.lit(True) if lo is None else F.col("t_ms") >= lo
        inside = inside if hi is None else inside & (F.col("t_ms") < hi)
        asked = pay.where(inside).select("tenant_id", "e2e")
        parts.append(evaluate_rules(pay, held, kept, store, apart).join(asked, ["tenant_id", "e2e"], "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def evaluate_rule(pay: DataFrame, rule: str, **parameters) -> DataFrame:
    """Results of one rule under its published configuration."""
    return evaluate_rules(pay, [rule_config(rule, **parameters)])

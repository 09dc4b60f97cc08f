"""Cases a review found: wide and equal amounts, versions, tenants, missing accounts, message keys, near places."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from payscope.config.rules import FULL_SET, rule_config, tenant_rule_configs
from payscope.config.typologies import tenant_typologies
from payscope.operators.rules import evaluate_rules
from payscope.plans.evaluate import evaluate_tenants, score_results
from payscope.sources.adapters import pay as stored_pay
from payscope.sources.messages import dedup_message
from payscope.sources.shared import shared_dir
from tests.conftest import skewed_events

T0 = 1_700_000_000_000


def payments(spark, rows):
    """Rows of (e2e, debtor, creditor, amount, seconds) with the other columns filled in."""
    full = [("t", e, f"m{e}", None if d is None else d // 2, c // 2, d, c, a, "USD", T0 + s * 1000 - 5, T0 + s * 1000, True, "x", "MP2P",
             0.0, 0.0) for e, d, c, a, s in rows]
    frame = spark.createDataFrame(full, "tenant_id string, e2e long, msg_id string, dbtr_id long, cdtr_id long, dbtr_acct long, "
                                        "cdtr_acct long, amt string, ccy string, req_ms long, t_ms long, ok boolean, descr string, "
                                        "tx_kind string, lat double, lon double")
    return frame.withColumns({"amt": F.col("amt").cast("decimal(18,2)"), "birth_date": F.lit("1980-01-01").cast("date")})


def refs(results):
    return {r.e2e: r.sub_rule_ref for r in results.collect()}


def test_equal_large_amounts_are_flat(spark):
    pay = payments(spark, [(i, 1, 2, "123456789012.37", i) for i in range(6)])
    for rule in ("020", "048"):
        assert refs(evaluate_rules(pay, [rule_config(rule)])) == {0: ".x01", **dict.fromkeys(range(1, 6), ".x04")}


def test_many_of_the_widest_amounts(spark):
    pay = payments(spark, [(i, 1, 2, "9000000000000000.00" if i % 2 else "9000000000000000.01", i) for i in range(150)])
    found = {r.e2e: r.value for r in evaluate_rules(pay, [rule_config("048")]).collect()}
    assert found[149] == pytest.approx(-1.0, abs=0.02) and found[148] == pytest.approx(1.0, abs=0.02)


def test_places_around_the_radius(spark):
    pay = payments(spark, [(0, 1, 2, "5.00", 0), (1, 1, 2, "5.00", 1), (2, 1, 2, "5.00", 2)])
    south = F.when(F.col("e2e") == 0, -4.9971 / 111.19492664).when(F.col("e2e") == 1, -0.006 / 111.19492664).otherwise(0.0)
    found = {r.e2e: r.value for r in evaluate_rules(pay.withColumn("lat", south), [rule_config("075")]).collect()}
    assert found[2] == 2.0


def test_versions_of_a_rule(spark):
    old, new = rule_config("901"), {**rule_config("901"), "cfg": "1.0.0"}
    pay = payments(spark, [(0, 1, 2, "5.00", 0), (1, 1, 2, "5.00", 1)])
    assert Counter(r.cfg for r in evaluate_rules(pay, [old, new]).collect()) == {old["cfg"]: 2, "1.0.0": 2}
    with pytest.raises(ValueError, match="twice"):
        evaluate_rules(pay, [old, old])


def test_tenants_score_by_their_own_weights(spark):
    pay = payments(spark, [(0, 1, 2, "5.00", 0), (1, 1, 2, "5.00", 1)])
    both = pay.withColumn("tenant_id", F.explode(F.array(F.lit("tenant-001"), F.lit("tenant-002"))))
    typologies = tenant_typologies()
    for t in typologies:
        if t["tenantId"] == "tenant-002":
            for rule in t["rules"]:
                for w in rule["wghts"]:
                    w["wght"] = float(w["wght"]) * 3
    scores = {(r.tenant_id, r.e2e): r.score for r in evaluate_tenants(both, tenant_rule_configs(), typologies).collect()}
    assert len(scores) == 4
    for e in (0, 1):
        assert scores["tenant-002", e] == 3 * scores["tenant-001", e] > 0
    one = evaluate_rules(both, [rule_config("901"), rule_config("902")])
    assert score_results(one, typologies).scores.count() == 4


def test_no_row_vanishes_without_an_account(spark):
    pay = payments(spark, [(0, 1, 2, "5.00", 0), (1, None, 2, "5.00", 1), (2, 1, 2, "6.00", 2)])
    found = evaluate_rules(pay, [rule_config(r) for r in [*FULL_SET, "901", "902"]])
    seen = Counter((r.rule_id, r.e2e) for r in found.select("rule_id", "e2e").collect())
    assert seen == {(r, e): 1 for r in [*FULL_SET, "901", "902"] for e in range(3)}
    lost = {r.rule_id: r.sub_rule_ref for r in found.where("e2e = 1").collect()}
    assert {lost[r] for r in ("004", "010", "018", "030", "048", "075", "090", "901")} == {".err"}


def test_mirroring_orders_single_payments(spark):
    pay = payments(spark, [(1, 5, 9, "900.00", 0), (2, 5, 9, "100.00", 0), (3, 8, 5, "100.00", 1)])
    row = evaluate_rules(pay, [rule_config("024")]).where("e2e = 3").first()
    assert (row.value, row.sub_rule_ref) == (1.0, ".01")


def test_accounts_held_up_to_the_payment(spark):
    pay = payments(spark, [(0, 2, 8, "5.00", 0), (1, 3, 8, "5.00", 1)])
    found = {r.e2e: r.value for r in evaluate_rules(pay, [rule_config("083")]).collect()}
    assert found == {0: 1.0, 1: 2.0}


def test_messages_by_their_unique_keys(spark):
    def settle(pairs):
        rows = spark.createDataFrame([("t", m, e, i) for i, (m, e) in enumerate(pairs)],
                                     "tenant_id string, message_id string, end_to_end_id string, seq int")
        return [tuple(r) for r in dedup_message(rows, ["seq"]).orderBy("seq").select("message_id", "end_to_end_id").collect()]

    assert settle([("m1", "e1"), ("m2", "e1"), ("m2", "e2")]) == [("m1", "e1"), ("m2", "e2")]
    import random
    rng = random.Random(2)
    pairs = [(f"m{rng.randrange(25)}", f"e{rng.randrange(25)}") for _ in range(120)]
    kept, ms, es = [], set(), set()
    for m, e in pairs:
        if m not in ms and e not in es:
            kept.append((m, e))
            ms.add(m)
            es.add(e)
    assert settle(pairs) == kept


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")


def test_widest_set_on_skewed_events(spark, tmp_path):
    pay = stored_pay(spark, str(skewed_events(tmp_path, n=60)))
    assert evaluate_rules(pay, [rule_config("021")]).count() == 60


def test_messages_without_keys_and_long_chains(spark):
    def settle(pairs):
        rows = spark.createDataFrame([("t", m, e, i) for i, (m, e) in enumerate(pairs)],
                                     "tenant_id string, message_id string, end_to_end_id string, seq int")
        return [r.seq for r in dedup_message(rows, ["seq"]).orderBy("seq").collect()]

    assert settle([(None, None), ("m", None), (None, None), ("m", "e"), (None, "e"), ("m", "f"), ("n", "f"), (None, "e")]) == [0, 1, 2, 4, 6]
    # each row clashes with the one before: only every other one is kept
    chain = [(f"m{i // 2}", f"e{(i + 1) // 2}") for i in range(3000)]
    assert settle(chain) == list(range(0, 3000, 2))


def test_own_typology_replaces_the_default_and_ids_stay_apart(spark):
    from payscope.plans.catalogue import shadowing_typologies
    pay = payments(spark, [(0, 1, 2, "5.00", 0)])
    both = pay.withColumn("tenant_id", F.explode(F.array(F.lit("tenant-001"), F.lit("tenant-002"))))
    results = evaluate_rules(both, [rule_config("901"), rule_config("902")])
    rows = score_results(results, shadowing_typologies()).decisions.collect()
    assert {(r.tenant_id, r.typology_id): r.score for r in rows} == {
        ("tenant-001", "typology-processor"): 600.0, ("tenant-001", "typology-second"): 200.0,
        ("tenant-002", "typology-processor"): 200.0, ("tenant-002", "typology-second"): 200.0}
    assert len(rows) == 4


def test_past_conditions_do_not_multiply_payments(spark):
    from payscope.operators.conditions import interval_join
    day = 86_400_000
    edges = spark.range(10_000).select(
        F.lit("t").alias("tenant_id"), F.lit("debtor").alias("role"), F.lit("account").alias("subject_type"), F.lit(1).cast("long").alias("source"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("destination"), F.array(F.lit("pacs.002.001.12")).alias("evt_tp"),
        (T0 - 200 * day - F.col("id") * 1000).alias("incptn_ms"), (T0 - 100 * day + F.col("id") * 1000).alias("xprtn_ms"),
        F.lit("override").alias("outcome"))
    now = edges.limit(1).withColumns({"destination": F.lit("now"), "incptn_ms": F.lit(T0 - 500 * day), "xprtn_ms": F.lit(T0 + 10)})
    ever = now.withColumns({"destination": F.lit("ever"), "incptn_ms": F.lit(T0 + 10), "xprtn_ms": F.lit(None).cast("long")})
    never = now.withColumns({"destination": F.lit("never"), "incptn_ms": F.lit(T0), "xprtn_ms": F.lit(T0)})
    brief = now.withColumns({"destination": F.lit("brief"), "incptn_ms": F.lit(T0 - day), "xprtn_ms": F.lit(T0 + 10_001)})
    pay = payments(spark, [(i, 1, 2, "5.00", i) for i in range(20)])
    every = edges.unionByName(now).unionByName(ever).unionByName(never).unionByName(brief)
    found = Counter(r.destination for r in interval_join(pay, every).collect())
    assert found == {"now": 1, "ever": 19, "brief": 11}


def test_versions_in_force(spark):
    from payscope.operators.rules.registry import in_force
    from payscope.operators.timeline import as_of
    events = spark.createDataFrame([("a", 5), ("a", 10), ("a", 10), ("a", 99), ("b", 7)], "k string, t long")
    versions = spark.createDataFrame([("a", 6, "x"), ("a", 10, "y"), ("a", 10, "z"), ("c", 1, "w")], "k string, since long, name string")
    got = Counter((r.k, r.t, r.version and r.version.name) for r in as_of(events, versions, ["k"], "t", "since").collect())
    assert got == {("a", 5, None): 1, ("a", 10, "z"): 2, ("a", 99, "z"): 1, ("b", 7, None): 1}
    docs = [{"id": "1", "cfg": "a", "n": 1}, {"id": "1", "cfg": "a", "n": 2, "validFrom": 50}, {"id": "2", "cfg": "a", "n": 3, "validFrom": 70}]
    assert [(lo, hi, [d["n"] for d in held]) for lo, hi, held in in_force(docs)] == [(None, 50, [1]), (50, 70, [2]), (70, None, [2, 3])]


def test_sketched_counterparties(spark):
    from payscope.plans.reports import counterparties, counterparties_sketched
    pay = payments(spark, [(i, i % 40, 100 + i % 997, "5.00", i) for i in range(6000)] + [(6000 + i, 100 + i, 5000 + i * 7 % 600, "5.00", i) for i in range(900)])
    exact = {(r.account, r.hop): r.counterparties for r in counterparties(pay, pay.select("tenant_id", F.col("dbtr_acct").alias("account"))).collect()}
    for r in counterparties_sketched(pay).collect():
        one, two = exact[r.account, 1], exact[r.account, 1] + exact[r.account, 2]
        assert abs(r.one_step - one) <= 0.15 * one + 1 and abs(r.two_steps - two) <= 0.15 * two + 1


def test_mapping_functions_are_checked():
    from payscope.functions.mapping import apply
    a = F.lit("1")
    for steps, why in ([{"name": "shell"}], "unknown"), ([{"name": "round", "args": [1]}], "takes"), (
            [{"name": "upper"}, {"name": "add", "args": [1]}], "takes"), ([{"name": "substring", "args": ["x", 1]}], "arguments"), (
            [{"name": "replace", "args": ["x"]}], "arguments"):
        with pytest.raises(ValueError, match=why):
            apply([a], steps)


def test_case_lifecycle(spark):
    from payscope.plans.reports import case_lifecycle
    log = spark.createDataFrame([(1, "2024-01-01", 0, "open"), (1, "2024-01-03", 0, "review"), (1, "2024-01-03", 1, "closed"),
                                 (1, "2024-01-10", 0, "open"), (1, "2024-01-11", 0, "open"), (1, "2024-01-12", 0, "closed"),
                                 (2, "2024-01-01", 0, "open"), (None, "2024-01-01", 0, "open")], "case_id long, day string, seq int, state string")
    got = {r.state: tuple(r)[1:] for r in case_lifecycle(log.withColumn("day", F.col("day").cast("date"))).collect()}
    assert got == {"open": (3, 2, 1, 4, 1), "closed": (2, 1, 0, 7, 1)}

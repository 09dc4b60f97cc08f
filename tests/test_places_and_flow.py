import random

from pyspark.sql import functions as F

from payscope.operators.conditions import event_flow
from payscope.operators.rules.places import _neighbours
from tests.conftest import rows_of


def test_neighbours_find_every_close_pair(spark):
    import math
    rng = random.Random(5)
    centres = [(0.0, 0.0), (48.2, 16.37), (-33.9, 179.99), (-33.9, -179.99), (89.7, 10.0), (89.7, -170.0), (-89.99, 0.0), (60.0, -180.0)]
    points = {(round(max(-90, min(90, a + rng.uniform(-.06, .06))), 3), round((b + rng.uniform(-.1, .1) + 180) % 360 - 180, 3))
              for a, b in centres for _ in range(25)}
    places = spark.createDataFrame([("x", float(a), float(b)) for a, b in points], "k string, lat double, lon double")

    def km(a, b):
        p = lambda d: d * math.pi / 180
        h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.sin(p(b[1] - a[1]) / 2) ** 2 * math.cos(p(a[0])) * math.cos(p(b[0]))
        return 2 * 6371 * math.asin(math.sqrt(h))
    got = {(r.lat, r.lon, r.n_lat, r.n_lon) for r in _neighbours(places, ["k"], 5.0).collect()}
    assert got == {(*a, *b) for a in points for b in points if km(a, b) <= 5.0}


def test_event_flow_interval_and_precedence(spark):
    pay = spark.createDataFrame([("t", i, at, 1, 2, 10, 20) for i, at in enumerate([99, 100, 149, 150, 199, 200])],
                                "tenant_id string, e2e long, t_ms long, dbtr_acct long, cdtr_acct long, dbtr_id long, cdtr_id long")
    edges = spark.createDataFrame([
        ("t", "debtor", "account", 1, ["pacs.002.001.12"], 100, 200, "overridable-block"),
        ("t", "creditor", "entity", 20, ["pacs.002.001.12"], 150, None, "override"),
        ("t", "creditor", "account", 2, ["pacs.008.001.10"], 0, None, "block"),
        ("u", "debtor", "account", 1, ["pacs.002.001.12"], 0, None, "block"),
        ("t", "debtor", "entity", 10, ["pacs.002.001.12"], 199, 200, "block")],
        "tenant_id string, role string, subject_type string, source long, evt_tp array<string>, incptn_ms long, xprtn_ms long, outcome string")
    got = {r.e2e: r.outcome for r in event_flow(pay, edges).collect()}
    assert got == {0: "none", 1: "overridable-block", 2: "overridable-block", 3: "override", 4: "non-overridable-block", 5: "override"}
    assert sum(rows_of(pay.select(F.col("e2e"))).values()) == 6

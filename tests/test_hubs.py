"""Rules 075 and 090 where one account, place or payer holds most rows: brute force, and work that does not multiply."""
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from payscope.config.rules import rule_config
from payscope.operators.rules import evaluate_rules
from payscope.operators.rules.places import nearby
from tests.test_review_cases import payments


def km(a, b):
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2)))


@pytest.mark.parametrize("lat,lon", [(0.0, 0.0), (51.5, -0.1), (-33.9, 179.99), (69.6, 18.9), (89.95, 10.0), (0.02, -180.0)])
def test_nodes_are_the_places_within_the_radius(spark, lat, lon):
    """Every known place within the radius lies in exactly one node, and no other place in any."""
    rng = random.Random(lat)
    spread = 0.12 / max(math.cos(math.radians(lat)), 0.02)
    places = {(max(-90.0, min(90.0, lat + rng.gauss(0, 0.05))), (lon + rng.gauss(0, spread) + 180) % 360 - 180) for _ in range(150)}
    places |= {(min(90.0, lat + rng.random() * 0.002), lon + rng.random() * 0.002 if lon < 179 else lon) for _ in range(60)}
    known = spark.createDataFrame([("a", la, lo) for la, lo in places], "acct string, lat double, lon double")
    asking = known.where(F.pmod(F.hash("lat", "lon"), F.lit(4)) == 0)
    parts = nearby(asking, known, ["acct"], 5.0)
    from payscope.operators.rules import places as grid
    held = grid._at_nodes(known.withColumns({"t_ms": F.lit(0), "count": F.lit(1)}), ["acct"], 5.0 / grid.KM_PER_DEGREE)
    got = parts.join(held, ["acct", "level", "x", "y"]).groupBy("lat", "lon").agg(F.sum("count").alias("n")).collect()
    want = {q: sum(km(q, p) <= 5.0 for p in places) for q in ((r.lat, r.lon) for r in asking.collect())}
    assert {(r.lat, r.lon): r.n for r in got} == want
    most = max(r.n for r in parts.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).collect())
    assert most < 210


def test_places_in_one_neighbourhood(spark):
    """Rule 075 by brute force for a debtor with very many places near by."""
    rng = random.Random(4)
    pay = payments(spark, [(i, 1, 2, "5.00", i // 2) for i in range(300)])
    at = {i: (48.0 + rng.gauss(0, 0.03), 11.0 + rng.gauss(0, 0.05)) for i in range(300)}
    where = F.create_map(*[x for i, (la, lo) in at.items() for x in (F.lit(i), F.struct(F.lit(la).alias("la"), F.lit(lo).alias("lo")))])
    pay = pay.withColumn("p", F.element_at(where, F.col("e2e").cast("int"))).withColumns({"lat": F.col("p.la"), "lon": F.col("p.lo")}).drop("p")
    got = {r.e2e: r.value for r in evaluate_rules(pay, [rule_config("075")]).collect()}
    for i in range(300):
        want = sum(km(at[i], at[j]) <= 5.0 for j in range(300) if j // 2 < i // 2)
        assert got[i] == (want if i >= 2 else None)


def brute_090(rows, day=86_400_000):
    out = {}
    for e, d, _, _, s in rows:
        t = s * 1000
        recent = [(a, b) for _, a, b, _, x in rows if t - day <= x * 1000 <= t - 1]
        payers = {a for a, b in recent if b == d}
        out[e] = len({b for a, b in recent if a in payers})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_union_of_payees_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        d = 1 if rng.random() < 0.3 else rng.randrange(2, 12)
        rows.append((i, d, 1 if rng.random() < 0.1 else rng.randrange(2, 14), "5.00", rng.randrange(0, 4 * 86_400, 3_600 if seed else 977)))
    got = {r.e2e: r.value for r in evaluate_rules(payments(spark, rows), [rule_config("090")]).collect()}
    assert got == brute_090(rows)


def test_payer_of_very_many(spark, monkeypatch):
    """A hub that pays 4000 accounts, each of which then pays: no payee is listed for any account."""
    from payscope.operators.rules import upstream
    listed = []
    real = upstream.staged
    monkeypatch.setattr(upstream, "staged", lambda rows, name: listed.append((name, real(rows, name))) or listed[-1][1])
    n = 4000
    rows = [(i, 1, 10 + i, "5.00", i) for i in range(n)] + [(n + i, 10 + i, 5, "1.00", n + i) for i in range(n)]
    got = evaluate_rules(payments(spark, rows), [rule_config("090")]).where(f"e2e >= {n}").groupBy("value").count().collect()
    assert [(r["value"], r["count"]) for r in got] == [(float(n), n)]
    assert dict(listed)["upstream-payees"].count() == 0


def brute_mirror(rows, rule):
    """Values of a mirroring rule: the newest opposite payments are added up until they reach the amount."""
    p = rule_config(rule)["config"]["parameters"]
    kept, creditor = 1 - Decimal(str(p.get("commission", 0))), rule in ("024", "026")
    slack, out = Decimal(str(p["tolerance"])), {}
    for e, d, c, a, s in rows:
        own, mine, theirs = (c, kept, 1) if creditor else (d, 1, kept)
        flow = sorted(((t, f, Decimal(b)) for f, x, y, b, t in rows if (x if creditor else y) == own and t <= s), reverse=True)
        low, high = (Decimal(a) * mine * (1 + sign * slack) for sign in (-1, 1))
        total, out[e] = Decimal(0), None
        for n, (t, _, b) in enumerate(flow, 1):
            total += b
            if total * theirs >= low:
                if total * theirs <= high and (s - t) * 1000 <= p["maxQueryRange"]:
                    out[e] = n
                break
    return out


@pytest.mark.parametrize("rule", ["024", "025", "026", "027"])
def test_mirroring_within_one_hour_of_one_account(spark, rule, monkeypatch):
    """All payments of a hot account lie in one hour: exact by brute force, and its rows spread over the ranges."""
    from payscope.operators import timeline
    written = []
    real = timeline.staged
    monkeypatch.setattr(timeline, "staged", lambda rows, name: written.append(real(rows, name)) or written[-1])
    rng = random.Random(int(rule))
    rows = [(i, *rng.choice([(1, 2), (2, 1), (1, 3), (3, 1), (4, 5)]), rng.choice(["0.00", "10.00", "10.00", "20.00", "9.70", "31.05"]),
             rng.randrange(0, 900)) for i in range(500)]
    rows += [(500 + i, 1, 2, "20.00", 7 * 86_400 * i) for i in range(1, 4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.e2e: r.value for r in evaluate_rules(payments(spark, rows), [rule_config(rule)]).collect()}
        hot = [r["count"] for r in written[0].where("acct = 1").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_mirror(rows, rule)
    assert got == want and sum(v is not None for v in want.values()) > 50
    assert len(hot) >= 3 and max(hot) < 0.5 * sum(hot)

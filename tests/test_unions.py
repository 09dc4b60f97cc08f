"""Unions of equally partitioned parts, which Spark may take for one partitioned whole."""
from __future__ import annotations


from payscope.operators import conditions as co
from payscope.sources.adapters import governed_edges, pay

SMALL = "/root/testdata/sf0.001"


def test_event_flow_without_broadcast(spark):
    """As on large tables: the semi-join is a sort-merge join, so payments and steps come hash-partitioned alike."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = pay(spark, SMALL)
        edges = governed_edges(p)
        flow = {(r.tenant_id, r.e2e): r.outcome for r in co.event_flow(p, edges).collect()}
        met = {}
        for r in co.interval_join(p, edges).select("tenant_id", "e2e", "outcome").collect():
            met.setdefault((r.tenant_id, r.e2e), set()).add(r.outcome)
        expected = {k: next((o for o in co.PRECEDENCE if o in met.get(k, ())), "none") for k in flow}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(o != "none" for o in expected.values()) > 20
    assert flow == expected

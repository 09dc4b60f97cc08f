from pathlib import Path

from payscope.sources.messages import dedup_message


def test_rows_without_a_clash_are_settled_in_one_pass(spark):
    """Rows and their verdict are written once each; no further pass looks for clashes where there are none."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    rows = spark.createDataFrame([("t", f"m{i}", f"e{i}" if i % 5 else None, i) for i in range(40)],
                                 "tenant_id string, message_id string, end_to_end_id string, seq long")
    before = set(shared.iterdir()) if shared.exists() else set()
    assert dedup_message(rows, ["seq"]).count() == 40
    assert sorted(p.name.split("-")[0] for p in set(shared.iterdir()) - before) == ["messages", "settled"]
    twice = rows.unionByName(spark.createDataFrame([("t", "m1", "e99", 50), ("t", "m98", "e99", 51), (None, "m1", None, 52)], rows.schema))
    got = {r.seq for r in dedup_message(twice, ["seq"]).collect()}
    assert got == {*range(40), 51, 52}

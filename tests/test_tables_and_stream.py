import pytest
from pyspark.sql import functions as F

from payscope.config.rules import rule_config
from payscope.operators.rules import evaluate_rules
from payscope.plans.catalogue import run_stream
from payscope.sources import messages as ms
from payscope.sources import tables as tb
from payscope.sources.adapters import pay
from tests.conftest import rows_of, skewed_events


def test_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tb.write_table(spark.range(3), path, "append").count() == 3
    assert tb.write_table(spark.range(2), path, "append").count() == 5
    assert tb.write_table(spark.range(4), path, "replace").count() == 4
    with pytest.raises(ValueError):
        tb.write_table(spark.range(1), path, "merge")


def test_upsert_keeps_untouched_partitions_and_latest_version(spark, tmp_path):
    path = str(tmp_path / "lake")
    base = spark.createDataFrame([(1, 1, "a", 0), (2, 5, "b", 0), (3, 1, "c", 1)], "id int, version int, x string, part int")
    base.write.partitionBy("part").parquet(path)
    changes = spark.createDataFrame([(1, 2, "A", 0), (2, 4, "late", 0), (4, 1, "new", 0)], "id int, version int, x string, part int")
    got = tb.lake_upsert(spark, path, changes, ["id"], ["version"], "part")
    assert {(r.id, r.x) for r in got.collect()} == {(1, "A"), (2, "b"), (3, "c"), (4, "new")}


def test_quarantine_ids_repeat_and_are_unique(spark):
    docs = spark.createDataFrame([(0, "{"), (1, '{"TenantId":"t"}'), (2, "not json")], "seq long, document string")
    v = ms.validate(ms.extract(docs, ms.PACS002, keep=["seq"]))
    q = lambda: {r.id: r.error for r in ms.quarantine(v, "/p", "c", "v1", F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    first = q()
    assert first == q() and len(first) == 3
    assert "message_id_not_null; cre_dt_tm; end_to_end_id_not_null" in first.values()


def test_rotation_keeps_backup(spark, tmp_path):
    tb.rotate_table(spark, "rot", spark.range(2), str(tmp_path), "20240101_000000")
    backup = tb.rotate_table(spark, "rot", spark.range(5), str(tmp_path), "20240102_000000")
    assert backup == "rot_backup_20240102_000000"
    assert spark.table("rot").count() == 5 and spark.table(backup).count() == 2


@pytest.mark.parametrize("rules", [("017", "901"), ("003", "045")])
def test_stream_equals_batch(spark, tmp_path, rules):
    """Three micro-batches over stored history give what one batch over everything gives."""
    folder = str(skewed_events(tmp_path, n=150))
    docs = [rule_config(r) for r in rules]
    root = run_stream(spark, folder, slices=3, rules=lambda: docs)
    columns = ["tenant_id", "e2e", "rule_id", "value", "sub_rule_ref"]
    assert rows_of(spark.read.parquet(f"{root}/results").select(*columns)) == rows_of(evaluate_rules(pay(spark, folder), docs).select(*columns))


def test_tenants_are_isolated(spark, tmp_path):
    """Two tenants with the same payments get the same results, and those of one alone."""
    docs = [rule_config(r) for r in ("002", "008", "045", "091", "901")]
    one = pay(spark, str(skewed_events(tmp_path, n=120))).withColumn("tenant_id", F.lit("a"))
    two = one.unionByName(one.withColumn("tenant_id", F.lit("b")))
    cols = ["e2e", "rule_id", "value", "sub_rule_ref"]
    both = evaluate_rules(two, docs).select("tenant_id", *cols)
    alone = rows_of(evaluate_rules(one, docs).select(*cols))
    assert rows_of(both.where("tenant_id = 'a'").select(*cols)) == alone
    assert rows_of(both.where("tenant_id = 'b'").select(*cols)) == alone

from payscope.config.typologies import TYPOLOGIES
from payscope.operators import typology as ty
from payscope.plans import catalogue
from tests.conftest import TESTDATA


def test_reports_read_stored_results(spark):
    """Scores and rule lists come from one stored evaluation; neither scans the time lines again."""
    plan = catalogue._reports(spark, str(TESTDATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" not in plan and "get_json_object" not in plan


def test_interdiction_sink_parses_events_once(spark, monkeypatch):
    def again(*_):
        raise AssertionError("events are parsed for every reader")
    monkeypatch.setattr(catalogue, "pay", again)
    assert set(catalogue.QUERIES["interdiction_sink"](spark, str(TESTDATA)).columns) == {"tenant_id", "e2e", "typology_cfg", "score"}


def test_configuration_tables_are_constants(spark):
    """No distributed list, whose reading starts Python workers; nulls, maps and lists come through."""
    doc = TYPOLOGIES["999-901"]
    weights, typologies = ty.weight_table(spark, [doc]), ty.typology_table(spark, [doc])
    assert "ExistingRDD" not in weights._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in weights._jdf.queryExecution().optimizedPlan().toString()
    listed = {(r["id"].split("@")[0], r["cfg"]): {w["ref"]: float(w["wght"]) for w in r["wghts"]} for r in doc["rules"]}
    got = {(r.rule_id, r.cfg): r.by_ref for r in weights.collect()}
    assert got == listed
    row = typologies.first()
    assert (row.alert_threshold, row.interdiction_threshold, row.shadowed) == (
        doc["workflow"].get("alertThreshold"), doc["workflow"].get("interdictionThreshold"), [])

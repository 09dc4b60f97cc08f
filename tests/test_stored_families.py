"""The full set of rules, whose families store their results one by one."""
import threading
import time

from payscope.config.rules import rule_config
from payscope.operators.rules import evaluate_rules, registry
from payscope.plans import catalogue
from payscope.sources.adapters import pay
from tests.conftest import rows_of, skewed_events


def test_full_results_are_stored_by_family(spark, tmp_path, monkeypatch):
    """The scores read stored results: no plan holds the shuffles of all families."""
    monkeypatch.setattr(catalogue, "FULL_SET", ["001", "030", "044", "091"])
    folder = str(skewed_events(tmp_path, n=60))
    stored = catalogue._full_results(spark, folder)
    assert "Aggregate" not in stored._jdf.queryExecution().optimizedPlan().toString()
    want = evaluate_rules(pay(spark, folder), [rule_config(r) for r in catalogue.FULL_SET])
    assert rows_of(stored) == rows_of(want)


def test_heavy_families_write_apart(spark, tmp_path, monkeypatch):
    now, most, lock = set(), [0], threading.Lock()

    def noted(step):
        with lock:
            now.add(threading.get_ident())
            most[0] = max(most[0], len(now))
        time.sleep(0.3)
        with lock:
            now.discard(threading.get_ident())
        return step()
    monkeypatch.setattr(registry, "_stored", noted)
    docs = [rule_config(r) for r in ("001", "021", "044")]
    rows = pay(spark, str(skewed_events(tmp_path, n=30)))
    evaluate_rules(rows, docs, store=True, apart=True)
    assert most[0] == 1
    evaluate_rules(rows, docs, store=True)
    assert most[0] > 1

"""Registered queries against their DuckDB statements on the smallest stored tables."""
import pytest

import __spark_entry__ as driver
from payscope.plans.catalogue import QUERIES
from tests.conftest import TESTDATA, connect, duck_rows, rows_of

STATEMENTS = driver.oracle_sql()
OWN = set(QUERIES)  # the corpus queries have tests of their own
# Rules have their own, harder test; the complete typology repeats them all.
NAMES = [n for n in QUERIES if not n.startswith("rule_0") and n not in ("rule_901", "rule_902", "typology_score")]

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="stored tables are not here")


def test_every_query_has_a_statement():
    assert OWN <= set(STATEMENTS) and OWN <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["tenant_id", "e2e", "typology_id", "typology_cfg", "score", "alert", "interdict"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert rows_of(driver.queries()[name](spark, str(TESTDATA))) == duck_rows(connect(TESTDATA), STATEMENTS[name])

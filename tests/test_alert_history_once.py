from pyspark.sql import functions as F

from payscope.plans.reports import alert_history


def test_alerts_are_found_once(spark):
    """The alerted payments are listed and counted from one stored copy, so payments are judged once."""
    pay = spark.range(6).select(F.lit("t").alias("tenant_id"), F.col("id").alias("e2e"), F.col("id").alias("t_ms"),
                                F.lit(1).alias("dbtr_acct"))
    status = pay.select("tenant_id", "e2e", F.when(F.col("e2e") % 2 == 0, "ALRT").otherwise("NALT").alias("status"))
    found = alert_history(pay, status)
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.e2e, r.alerts_so_far) for r in found.collect()) == [(0, 1), (2, 2), (4, 3)]

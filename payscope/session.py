"""Session settings the operators count on."""
from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",  # partition coalescing, join choice at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",  # splits hot accounts in joins back to the payments
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.unionOutputPartitioning": "false",  # see plain_unions
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings; shuffle partitions, memory and the checkpoint folder stay the cluster's own."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def plain_unions(spark: SparkSession) -> None:
    """Tell the session that a union has no partitioning of its own.

    Spark 4.1 takes a union of equally partitioned parts for partitioned as they are and leaves the next exchange out. Where
    adaptive execution then reuses or reads one part's exchange otherwise, rows of one key lie in several partitions, and
    windows and joins above the union lose them without an error.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")

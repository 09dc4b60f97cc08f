"""Landing, writing, replacing and upserting tables, and the job log."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .messages import first_per_key
from .shared import shared_dir


def save(rows: DataFrame, path: str, mode: str, partitions: Sequence[str] = (), dynamic: bool = False) -> None:
    """Write Parquet. Rows are rebalanced by the partition columns first: one folder's rows come together instead of
    every task opening every folder, and AQE splits a folder that is too large for one task."""
    if not partitions:
        rows.write.mode(mode).parquet(path)
        return
    writer = rows.hint("rebalance", *partitions).write.mode(mode).partitionBy(*partitions)
    (writer.option("partitionOverwriteMode", "dynamic") if dynamic else writer).parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "append", partitions: Sequence[str] = ()) -> DataFrame:
    """Write Parquet (``append`` or ``replace``) and return the table as read back."""
    if mode not in ("append", "replace"):
        raise ValueError(f"mode must be append or replace, not {mode}")
    save(rows, path, "append" if mode == "append" else "overwrite", partitions)
    return rows.sparkSession.read.parquet(path)


def ingest_pull(spark: SparkSession, job: Mapping, table_path: str) -> DataFrame:
    """Load the files a pull job has landed. ``job``: file{path, format, options, schema}, mode."""
    file = job["file"]
    reader = spark.read.format(file.get("format", "csv")).options(**file.get("options", {}))
    if file.get("schema"):
        reader = reader.schema(file["schema"])
    return write_table(reader.load(file["path"]), table_path, job.get("mode", "append"))


def ingest_push(batch: DataFrame, job: Mapping, table_path: str) -> DataFrame:
    """Append or replace a pushed batch under its endpoint path and version."""
    tagged = batch.withColumns({"endpoint_path": F.lit(job["path"]), "version": F.lit(job.get("version", "v1"))})
    if job["mode"] == "replace":
        save(tagged, table_path, "overwrite", ["endpoint_path", "version"], dynamic=True)
        return batch.sparkSession.read.parquet(table_path)
    return write_table(tagged, table_path, "append", ["endpoint_path", "version"])


def enrich_rows(rows: DataFrame, job_id: str) -> DataFrame:
    """Rows as (data JSON, job_id, checksum); the checksum is SHA-256 of the JSON text (ours)."""
    return (rows.select(F.to_json(F.struct("*")).alias("data"))
            .select("data", F.lit(job_id).alias("job_id"), F.sha2("data", 256).alias("checksum")))


def rotate_table(spark: SparkSession, table: str, rows: DataFrame, root: str, stamp: str) -> str:
    """Replace a catalog table by rename: write a new table, keep the old as ``<table>_backup_<stamp>``."""
    fresh, backup = f"{table}_{stamp}", f"{table}_backup_{stamp}"
    rows.write.option("path", f"{root}/{fresh}").saveAsTable(fresh)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {backup}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    return backup


def job_history(written: DataFrame, valid: Column, tenant: str, job_id: str, job_type: str,
                exception: str | None = None) -> DataFrame:
    """One log row per run: rows seen and rows accepted."""
    return written.agg(F.count(F.lit(1)).alias("counts"), F.count(F.when(valid, 1)).alias("processed_counts")).select(
        F.lit(tenant).alias("tenant_id"), F.lit(job_id).alias("job_id"), "counts", "processed_counts",
        F.lit(exception).cast("string").alias("exception"), F.lit(job_type).alias("job_type"))


def enrich_join(transactions: DataFrame, enrichment: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Transactions with the columns of an enrichment table; Spark broadcasts it only if its size allows."""
    keyed = enrichment.withColumnsRenamed({v: k for k, v in on.items()})
    return transactions.join(keyed, list(on), "left")


def etl_extract(history: DataFrame, time: str, high_water: int, until: int | None = None) -> DataFrame:
    """Rows newer than the last extract. The bound is a plain column filter: it reaches the scan where ``time`` is stored;
    for a computed time give the source its own bound as well (see ``adapters.pay``)."""
    rows = history.where(F.col(time) > high_water)
    return rows if until is None else rows.where(F.col(time) <= until)


def latest_per_key(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in version]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*version, *rest), F.struct(*version)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keyed upsert, latest version wins."""
    return latest_per_key(base.unionByName(changes, allowMissingColumns=True), keys, version)


def lake_upsert(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], version: Sequence[str],
                partition: str) -> DataFrame:
    """Upsert into a partitioned Parquet table, rewriting only the partitions that have changes.

    The partition column must be a function of the key. Affected partitions are merged into a staging folder first,
    because a Parquet table cannot be overwritten while it is read.
    """
    base = spark.read.parquet(path)
    touched = base.join(changes.select(partition).distinct(), partition, "left_semi")
    staged = shared_dir(spark, "upsert-stage")
    upsert(touched, changes, keys, version).write.parquet(staged)
    save(spark.read.parquet(staged), path, "overwrite", [partition], dynamic=True)
    return spark.read.parquet(path)


def update_rows(table: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """SQL UPDATE ... FROM: rows with a change take its columns (one change per key), others stay."""
    fresh = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(fresh, list(keys), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns
                           else F.col(c) for c in table.columns])


def delete_rows(table: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(doomed, list(keys), "left_anti")


def insert_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows whose key is not in the table yet, one per key; append these and return their keys."""
    return first_per_key(rows, keys, order).join(table.select(*keys), list(keys), "left_anti")


def write_by_tenant(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Egress dataset split by tenant and day."""
    return write_table(rows, path, mode, ["tenant_id", "day"])

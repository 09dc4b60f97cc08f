from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

TESTDATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("payscope-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(connection, sql: str) -> Counter:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    return Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def connect(folder) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def skewed_events(folder: Path, n: int = 500, seed: int = 7) -> Path:
    """Events in which one account sends and one receives a third of all payments, with many equal times and amounts."""
    import random
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + timedelta(minutes=30 * rng.randrange(0, 48 * 6), milliseconds=rng.choice([0, 0, 0, 1]))
        rows.append((i, at, 2 if rng.random() < 0.33 else rng.randrange(0, 12),
                     rng.choice(["click", "purchase", "view", "signup", "error"]),
                     rng.choice([0.0, 10.0, 10.0, 9.0, 11.0, 20.01, 99.99, 500.0, 10000.0]),
                     '{"k": %d}' % (4 if rng.random() < 0.33 else rng.randrange(0, 12))))
    columns = list(zip(*rows))
    table = pa.table({"event_id": pa.array(columns[0], pa.int64()), "ts": pa.array(columns[1], pa.timestamp("us")),
                      "user_id": pa.array(columns[2], pa.int64()), "event_type": pa.array(columns[3]),
                      "value": pa.array(columns[4], pa.float64()), "props": pa.array(columns[5])})
    pq.write_table(table, folder / "events.parquet")
    return folder

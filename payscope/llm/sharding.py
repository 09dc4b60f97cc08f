"""Shards of nearly equal bytes by histogram sort, with one exchange of the documents."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

from .histogram import place, sortable, splitters

WIDTH = 24
#: Bytes of documents in one range of the exchange, about, and ranges of a shard at least.
RANGE_BYTES = 64 << 20
SHARD_RANGES = 64
#: Part of a shard's bytes by which a border may miss its place; where documents allow no more, the nearest one is taken.
TOLERANCE = 0.001


def shard(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id",
          tolerance: float = TOLERANCE) -> DataFrame:
    """``row`` (a struct of the document's columns), ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot`` in it.

    A document's size is the UTF-8 bytes of its text plus 8; a null text has none. Documents are sorted by text hash,
    then key, then a row number, so equal texts lie side by side and stay in one shard unless the border must cut their
    group to keep the sizes equal. Slots are gapless from 0 in sort order. Null keys sort first. Rows that repeat are
    kept, each with a slot of its own. An empty table gives an empty table.

    The documents are written once with their sort key (a row number must not change between passes), the passes of the
    histogram read keys and sizes only, and the exchange moves the documents once, in ranges of bounded size.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "shard-input")
    row = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    row.select("row", (F.octet_length(body) + 8).cast("long").alias("size"), sortable(
        F.xxhash64(body), F.col(f"row.`{key}`").cast("long"), F.monotonically_increasing_id()).alias("key")
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    keys = stored.select("key", "size")
    count, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = int(min(max(SHARD_RANGES, -(-total // (shards * RANGE_BYTES))), max(1, count // (8 * shards))))
    ranges = shards * pieces
    targets = [total * k / ranges for k in range(1, ranges)]
    tight = total / shards * tolerance
    cuts, _, _ = splitters(keys, targets, [tight if k % pieces == 0 else total / ranges / 2 for k in range(1, ranges)],
                           WIDTH)
    first = np.array([0, *[c.rows for c in cuts]], np.int64)
    of = np.arange(ranges) // pieces
    base = first[of * pieces] if len(first) == ranges else np.zeros(ranges, np.int64)

    @F.pandas_udf("shard int, first long")
    def shard_of(pieces_: pd.Series) -> pd.DataFrame:
        at = pieces_.to_numpy()
        return pd.DataFrame({"shard": of[at].astype(np.int32), "first": (first - base)[at]})

    placed = stored.withColumn("range", place(F.col("key"), cuts, WIDTH))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("key")))
    return numbered.withColumn("at", shard_of("range")).select(
        "row", "size", F.col("at.shard").alias("shard"), (F.col("at.first") + F.col("n") - 1).alias("slot"))

"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents are shuffled by a hash and laid end to end on a line of tokens, twice over. The line is cut into
blocks of equal size, and a source whose target is ``t`` needs its first ``ceil(t / block)`` blocks, the last one cut at
the target. The blocks of all sources, side by side, are the cumulative weights on a grid of ``2^k`` cells; the van der
Corput points of ``k`` bits visit each cell once, in bit-reversed order. The slot of a cell is that point's number, and
the r-th slot of a source in this order takes the r-th block of its line. Every stretch of the schedule thus holds all
sources nearly in proportion to their targets.

Rank within a source. Slots before that of cell ``j`` belong to cells that, for some set bit ``c`` of ``j``, agree with
``j`` below ``c``, have no bit ``c`` and anything above: ``low, low + 2^(c+1), ...`` with ``low = j mod 2^c``. Those in
the source's cells ``[first, end)`` are counted by two divisions for each bit, so that no source is sorted in one task.

Nulls: a null text has size 0, a null source is a source of its own (the last one), a null key is a key like any other.
Rows equal in key, source and size are laid one after another and share their takes in any order (their number must fit
an array). An empty table, and documents without words, give no slots and take 0. Other columns are left out, so their
names cannot clash.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, documents in one group of a shuffled line, and cells of the grid that one task unrolls at once.
BLOCK = 256
LINE_ROWS = 4096
CELLS = 1 << 14


class Mix(NamedTuple):
    """``plan``: a row for each source; ``schedule``: source, r, slot; ``pieces``: the mix itself, a row for each part of
    a document in a slot (``start``: its first word there, ``length``); ``taken``: a row for each document."""
    plan: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    taken: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: DataFrame, weights: Sequence[float], share: float, most: float, block: int) -> DataFrame:
    """Targets by filling up: sources share ``share`` of all sizes by weight, none above ``most`` times its own size.

    Resharing what is above the limits by weight until nothing is ends where all open sources have one ratio ``level`` of
    target to weight, and all others, those of least ``limit / weight``, their limit. One row for each source is sorted.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    given = F.array(*[F.lit(float(w)) for w in weights])
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = (by_source.withColumn("no", no).withColumn("weight", F.get(given, F.col("no") % len(weights)))
               .withColumn("limit", F.col("source_size") * float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "no")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(every) * float(share)
    level = ((total - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    filled = (weighed.withColumn("level", level)
              .withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
              .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "no", "level")))
                          .over(every)["level"]))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(
        F.least("limit", F.col("level") * F.col("weight")))
    placed = (filled.withColumn("target", target).withColumn("cut", F.round("target").cast("long"))
              .withColumn("blocks", F.ceil(F.col("cut") / block)))
    end = F.sum("blocks").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    cells = F.sum("blocks").over(every)
    return placed.select("source", "no", "weight", "source_size", "n_docs", "target", "cut", "blocks",
                         (end - F.col("blocks")).alias("first"), end.alias("end"),
                         F.length(F.bin(F.greatest(cells - 1, F.lit(0)))).alias("bits"))


def schedule(plan: DataFrame) -> DataFrame:
    """``no, r, slot``: the slot that takes block ``r`` of a source, for every block of every source. Its rows are made
    from few, so the tasks are named: Spark would take so small an input to one."""
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = plan.where("blocks > 0").select(
        "no", "first", "end", "bits", F.explode(F.sequence("first", F.col("end") - 1, F.lit(CELLS))).alias("chunk"))
    cells = (chunks.repartition(tasks, "chunk").select(
        "no", "first", "end", "bits", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CELLS, "end") - 1)).alias("j")))
    rank = F.aggregate(
        F.sequence(F.lit(0), F.col("bits") - 1), F.lit(0).cast("long"),
        lambda done, c: done + F.when(F.col("j").bitwiseAND(_power(c)) != 0, _upto("end", c) - _upto("first", c))
        .otherwise(F.lit(0).cast("long")))
    slot = F.conv(F.reverse(F.lpad(F.bin("j"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    return cells.select("no", rank.alias("r"), slot.alias("slot"))


def _power(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), c)


def _upto(edge: str, c: Column) -> Column:
    """How many of ``low, low + 2^(c+1), ...`` lie below ``edge``, with ``low = j mod 2^c``."""
    low = F.col("j").bitwiseAND(_power(c) - 1)
    return F.call_function("div", F.col(edge) - low + _power(c) * 2 - 1, _power(c) * 2)


def lines(sizes: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``key, source, size, no, at``: where each document lies on its source's line, in the order of its hash.

    A source of any size is dealt by hash into groups of some thousand documents; sums of the groups carry on the line.
    """
    whole = sizes.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    known = plan.select(F.col("source").alias("of"), "no", "n_docs", "source_size", "target", "cut")
    dealt = (whole.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("hash", digest)
             .withColumn("group", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
                                          * F.ceil(F.col("n_docs") / LINE_ROWS) / F.lit(float(1 << 32)))))
    length = F.col("size") * F.col("copies")
    groups = dealt.groupBy("no", "group").agg(F.sum(length).alias("length"))
    ahead = Window.partitionBy("no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("no", "group", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("no", "group").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(bases, ["no", "group"])
    return placed.select("key", "source", "size", "no", "source_size", "target", "cut",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
                         (F.col("base") + F.col("inside")).alias("run")).withColumn(
        "at", F.col("run") + F.col("copy") * F.col("size")).drop("run")


def _cuts(lined: DataFrame, epochs: int, block: int) -> DataFrame:
    """Each document with its parts in the blocks it reaches below the cut. One that reaches none gets a number below 0,
    dealt by hash, so that these do not meet in one task."""
    per_epoch = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)),
                            lambda e: F.struct((F.col("at") + e * F.col("source_size")).alias("lo")))
    wanted = F.filter(per_epoch, lambda s: (s["lo"] < F.col("cut")) & (F.col("size") > 0))
    parts = F.flatten(F.transform(wanted, lambda s: F.transform(
        F.sequence(F.call_function("div", s["lo"], F.lit(block).cast("long")),
                   F.call_function("div", F.least(s["lo"] + F.col("size"), F.col("cut")) - 1, F.lit(block).cast("long"))),
        lambda r: F.struct(
            r.alias("r"), (F.greatest(s["lo"], r * block) - s["lo"]).alias("start"),
            (F.least(s["lo"] + F.col("size"), F.col("cut"), (r + 1) * block) - F.greatest(s["lo"], r * block)).alias("length")))))
    nowhere = -1 - F.pmod(F.xxhash64("key", "copy"), F.lit(1 << 20))
    return (lined.withColumn("part", F.explode_outer(parts))
            .select("*", F.coalesce("part.r", nowhere).alias("r"), "part.start", "part.length").drop("part"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK,
        seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> Mix:
    """Mix ``docs`` so that its sources, by name, weigh ``weights`` in turn; see the module for the method.

    Word counts and the plan are written once to the shared folder; a rerun with the same seed gives the same mix.
    """
    spark = docs.sparkSession
    sizes = _stored(spark, "mix-sizes", docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"),
                                                    words(F.col(f"`{text}`")).alias("size")))
    planned = _stored(spark, "mix-plan", plan(sizes, weights, share, most, block))
    lined = _cuts(lines(sizes, planned, seed), most, block)
    slots = schedule(planned)
    # the schedule grows with the input, though Spark sees only the few rows it is made from
    joined = lined.join(slots.hint("merge"), ["no", "r"], "left")
    pieces = (joined.where("slot is not null")
              .select("slot", "source", "r", F.col("key").alias(key), "copy", "start", "length"))
    taken = joined.groupBy("key", "source", "size", "copy").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("length"))), F.lit(0)).alias("taken"))
    return Mix(planned, slots, pieces, taken.withColumnRenamed("key", key))


def _stored(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    path = shared_dir(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)

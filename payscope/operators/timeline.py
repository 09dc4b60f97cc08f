"""Running and sliding aggregates over event time that stay balanced when one key is hot.

A window partitioned by account puts an account's whole history into one task. Every operator here instead

1. folds rows of the same (key, millisecond) with an ordinary map-side-combined aggregation,
2. runs windows inside (key, time block), so a task never holds more than one block of distinct milliseconds,
3. carries whole-block totals forward with a window over blocks (hours of history, not rows), and
4. adds carry and local value.

Sliding sums are running sums in which a contribution made at ``t`` is taken back at ``t + range + 1``, so they
cost the same as running sums and need no frame that grows with the range. Frames follow event milliseconds and
include ties, i.e. ``[t - range, t]``.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import plain_unions
from ..sources.shared import staged

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


@dataclass(frozen=True)
class Measure:
    """One aggregate of a scan.

    ``sum`` gives ``name`` over all contributions up to and including ``t`` (within ``range_ms`` if set) and, with
    ``here``, ``name_here`` for those made at ``t``. ``min``/``max`` give ``name`` over strictly earlier rows and, with
    ``here``, ``name_here`` over those at ``t``.
    """

    name: str
    op: str = "sum"
    range_ms: int | None = None
    here: bool = False


FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def block_of(time: Column, block_ms: int) -> Column:
    """Index of the fixed-width time block; exact and monotone also before the epoch."""
    return ((time - F.pmod(time, F.lit(block_ms))) / block_ms).cast("bigint")


def _known(rows: DataFrame, keys: Sequence[str], time: str, block_ms: int) -> DataFrame:
    """Rows with a complete key. The later joins imply the same checks for one use of the rows but not the other;
    stated here they are equal, so Spark shuffles the rows once for both."""
    given = [F.col(c).isNotNull() for c in (*keys, time)]
    return rows.where(reduce(Column.__and__, [*given, block_of(F.col(time), block_ms).isNotNull()]))


def scan(rows: DataFrame, keys: Sequence[str], time: str, measures: Sequence[Measure],
         deltas: DataFrame | None = None, block_ms: int = DAY_MS, along: Sequence[str] = ()) -> DataFrame:
    """Evaluate ``measures`` per (keys, time) of the rows flagged ``real``.

    ``rows`` has the keys, the time, a boolean ``real`` and one column per measure (null: no contribution).
    ``deltas`` may add signed contributions at other times (keys, time and some measure columns). Columns ``along`` (the
    greatest of a (keys, time)) come back with their moment.
    """
    plain_unions(rows.sparkSession)
    keys = list(keys)
    names = [m.name for m in measures]
    moments = _known(rows, keys, time, block_ms).groupBy(*keys, time).agg(
        F.max("real").alias("real"), *[FOLD[m.op](m.name).alias(m.name) for m in measures], *[F.max(c).alias(c) for c in along])
    here = [m.name for m in measures if m.here]
    carried = [*[f"{n}_here" for n in here], *along]
    steps = moments.select(*keys, time, "real", *names, *[F.col(n).alias(f"{n}_here") for n in here], *along)
    ranges = sorted({m.range_ms for m in measures if m.range_ms is not None})
    if ranges:
        fields = {f.name: f.dataType for f in steps.schema.fields}

        def step(shift, r=None):
            cells = [(F.col(time) + shift).alias(time), (F.col("real") if r is None else F.lit(False)).alias("real")]
            for m in measures:
                value = F.col(m.name) if r is None else (-F.col(m.name) if m.range_ms == r else F.lit(None))
                cells.append(value.cast(fields[m.name]).alias(m.name))
            for n in carried:
                value = F.col(n) if r is None else F.lit(None)
                cells.append(value.cast(fields[n]).alias(n))
            return F.struct(*cells)

        def steps_of(r):  # what contributed nothing has nothing to take back
            return F.when(F.coalesce(*[m.name for m in measures if m.range_ms == r]).isNotNull(), step(r + 1, r))

        ends = F.filter(F.array(*[steps_of(r) for r in ranges]), lambda s: s.isNotNull())
        steps = steps.select(*keys, F.inline(F.concat(F.array(step(0)), ends)))
    if deltas is not None:
        given = [n for n in names if n in deltas.columns]
        folded = deltas.groupBy(*keys, time).agg(*[F.sum(n).alias(n) for n in given]).withColumn("real", F.lit(False))
        steps = steps.unionByName(folded, allowMissingColumns=True)
    steps = steps.withColumn("_block", block_of(F.col(time), block_ms))

    in_block = Window.partitionBy(*keys, "_block").orderBy(time)
    through = in_block.rangeBetween(Window.unboundedPreceding, 0)
    before = in_block.rangeBetween(Window.unboundedPreceding, -1)
    local = steps.select(
        *keys, time, "_block", "real", *carried,
        *[FOLD[m.op](m.name).over(through if m.op == "sum" else before).alias(f"_l_{m.name}") for m in measures])

    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (steps.groupBy(*keys, "_block")
             .agg(F.max("real").alias("_wanted"), *[FOLD[m.op](m.name).alias(m.name) for m in measures])
             .select(*keys, "_block", "_wanted",
                     *[FOLD[m.op](m.name).over(earlier).alias(f"_c_{m.name}") for m in measures])
             .where("_wanted").drop("_wanted"))

    def combined(m: Measure) -> Column:
        a, b = F.col(f"_l_{m.name}"), F.col(f"_c_{m.name}")
        if m.op == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.least(a, b) if m.op == "min" else F.greatest(a, b)

    return local.where("real").join(carry, [*keys, "_block"]).select(
        *keys, time, *[combined(m).alias(m.name) for m in measures],
        *[F.coalesce(F.col(f"{m.name}_here"), F.lit(0 if m.op == "sum" else None)).alias(f"{m.name}_here")
          for m in measures if m.here], *along)


def range_max(rows: DataFrame, keys: Sequence[str], time: str, value: str, range_ms: int,
              include_now: bool, block_ms: int = DAY_MS) -> DataFrame:
    """Maximum of ``value`` over ``[t - range, t]`` (or up to ``t - 1``) for each ``real`` moment.

    A maximum cannot be taken back like a sum, so the range is cut at block edges: the rest of the block in which it
    begins (suffix maximum), the whole blocks between (window over block maxima), and the block in which it ends
    (prefix maximum).
    """
    keys = list(keys)
    block_ms = min(block_ms, range_ms)
    whole = range_ms // block_ms
    moments = (_known(rows, keys, time, block_ms).groupBy(*keys, time).agg(F.max("real").alias("real"), F.max(value).alias("_m"))
               .withColumn("_block", block_of(F.col(time), block_ms)))

    tail_frame = (Window.partitionBy(*keys, "_block").orderBy(time)
                  .rangeBetween(Window.unboundedPreceding, 0 if include_now else -1))
    tail = (moments.select(*keys, time, "_block", "real", F.max("_m").over(tail_frame).alias("_tail"))
            .where("real").drop("real"))

    points = moments.select(*keys, F.col(time).alias("_at"), F.lit(None).cast("bigint").alias("_for"), "_m")
    probes = moments.where("real").select(
        *keys, (F.col(time) - range_ms).alias("_at"), F.col(time).alias("_for"),
        F.lit(None).cast(moments.schema["_m"].dataType).alias("_m"))
    suffix = (Window.partitionBy(*keys, "_block").orderBy(F.col("_at").desc())
              .rangeBetween(Window.unboundedPreceding, 0))
    head = (points.unionByName(probes).withColumn("_block", block_of(F.col("_at"), block_ms))
            .select(*keys, "_for", F.max("_m").over(suffix).alias("_head"))
            .where("_for is not null").withColumnRenamed("_for", time))

    by_block = Window.partitionBy(*keys).orderBy("_block")
    blocks = moments.groupBy(*keys, "_block").agg(F.max("real").alias("real"), F.max("_m").alias("_m"))
    shorter = (F.max("_m").over(by_block.rangeBetween(-(whole - 1), -1)) if whole > 1
               else F.lit(None).cast(moments.schema["_m"].dataType))
    middle = (blocks.select(*keys, "_block", "real", shorter.alias("_mid_short"),
                            F.max("_m").over(by_block.rangeBetween(-whole, -1)).alias("_mid_long"))
              .where("real").drop("real"))

    starts_in = block_of(F.col(time) - range_ms, block_ms)
    mid = F.when(F.col("_block") - starts_in == whole, F.col("_mid_short")).otherwise(F.col("_mid_long"))
    return (tail.join(middle, [*keys, "_block"]).join(head, [*keys, time])
            .select(*keys, time, F.greatest("_tail", "_head", mid).alias(value)))


def recent(rows: DataFrame, keys: Sequence[str], time: str, item: str, n: int, block_ms: int = DAY_MS) -> DataFrame:
    """The ``n`` greatest ``item`` structs with strictly earlier time, newest first, per (keys, time).

    ``item`` is a struct that begins with the time. At most ``n`` items per millisecond and per block are kept, by
    ranked windows that Spark limits before the shuffle, so no list grows with the history.
    """
    keys = list(keys)
    if n < 1:
        empty = F.array().cast(f"array<{rows.schema[item].dataType.simpleString()}>")
        return rows.select(*keys, time).distinct().withColumn("recent", empty)

    def newest(groups: DataFrame, by: list[str], order: str, item_col: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
        return (groups.withColumn("_rank", rank).where(F.col("_rank") <= n)
                .groupBy(*by).agg(F.collect_list(item_col).alias("_items")))

    def top(lists: Column) -> Column:
        return F.slice(F.sort_array(F.flatten(lists), asc=False), 1, n)

    moments = (newest(_known(rows.select(*keys, time, item), keys, time, block_ms), [*keys, time], item, F.col(item))
               .withColumn("_block", block_of(F.col(time), block_ms)))
    before = Window.partitionBy(*keys, "_block").orderBy(time).rowsBetween(-n, -1)
    local = moments.select(*keys, time, "_block", top(F.collect_list("_items").over(before)).alias("_local"))
    blocks = (newest(moments.withColumnRenamed("_items", "_lists"), [*keys, "_block"], time, F.col("_lists"))
              .withColumn("_items", top(F.col("_items"))))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-n, -1)
    carry = blocks.select(*keys, "_block", top(F.collect_list("_items").over(earlier)).alias("_carry"))
    return (local.join(carry, [*keys, "_block"])
            .select(*keys, time, top(F.array("_local", "_carry")).alias("recent")))


def coverage(pair_times: DataFrame, keys: Sequence[str], time: str, previous: str, range_ms: int,
             name: str) -> DataFrame:
    """Signed steps whose running sum counts the distinct members seen in ``[t - range, t]``.

    ``pair_times`` has one row per (key, member) and time, with the member's ``previous`` time. A member counts
    from each of its times until ``range`` later; where two such stretches meet, the first one's end is undone.
    """
    joined = F.coalesce(F.col(previous) + (range_ms + 1) >= F.col(time), F.lit(False))
    begin = F.when(joined, F.col(previous) + (range_ms + 1)).otherwise(F.col(time))
    steps = F.array(F.struct(begin.alias(time), F.lit(1).cast("bigint").alias(name)),
                    F.struct((F.col(time) + (range_ms + 1)).alias(time), F.lit(-1).cast("bigint").alias(name)))
    return pair_times.select(*keys, F.inline(steps))


def merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner-join frames that hold the same keys."""
    return reduce(lambda a, b: a.join(b, list(keys)), frames)


def as_of(events: DataFrame, versions: DataFrame, keys: Sequence[str], time: str, since: str) -> DataFrame:
    """Events with ``version``, the row of ``versions`` (a struct) of the same keys that was last to begin at or before the
    event's time; null where none had. Of versions that begin together the greatest row holds.

    Versions and events run along one line and the last version is carried, so neither the number of versions nor a key
    that holds most events makes a group that one task must hold. Keys must not be null.
    """
    keys = list(keys)
    body = F.struct(F.col(since).alias(since), *[c for c in versions.columns if c not in keys and c != since])
    steps = versions.select(*keys, (F.col(since) - 1).alias(time), F.lit(False).alias("real"), body.alias("version"))
    asks = events.select(*keys, time).distinct().select(*keys, time, F.lit(True).alias("real"),
                                                        F.lit(None).cast(steps.schema["version"].dataType).alias("version"))
    line = scan(asks.unionByName(steps), keys, time, [Measure("version", "max")])
    return events.join(line, [*keys, time], "left")


def last_up_to(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``value`` replaced by the last one that is not null among the rows of the same ``keys`` up to each row.

    Rows are sorted by keys and order in ranges of about equal rows, so a hot key spreads over as many tasks as its rows
    fill; a task looks back inside its range, and the last value of each range is carried over its border to rows of the
    same keys. The carry is one row for each shuffle partition. The ranges are written once, because two runs of a range
    exchange need not cut at the same rows; this runs a job. Rows without a complete key are left out; ties in ``order``
    must be rows among which any may come first.
    """
    keys, order = list(keys), list(order)
    given = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    parted = staged(given.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = parted.groupBy("_part").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(*keys, *order, value))).alias("_end"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_end"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(Column.__and__, [F.col(f"_end.{k}") == F.col(k) for k in keys])
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.when(same, F.col(f"_end.{value}")))
    return parted.join(F.broadcast(carry), "_part", "left").withColumn(value, found).drop("_part", "_end")

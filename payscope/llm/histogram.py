"""Histogram sort: splitters of a sort key found by counting exact bytes below candidate boundaries.

A key is a binary value of fixed width that sorts like the columns it is made of, so a boundary is an integer. Each round
counts rows and bytes of the intervals between all probes in one distributed aggregation; the intervals that still hold
a target are probed again, more finely, between the smallest and largest key met in them. Nothing but these counts
reaches the driver: PROBES intervals a round and one for each target.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 8_192


def sortable(*columns: Column) -> Column:
    """Longs as one binary value that sorts like them, in this order; nulls come as the smallest long."""
    parts = [F.lpad(F.hex(F.coalesce(c, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") for c in columns]
    return F.unhex(F.concat(*parts))


@dataclass(frozen=True)
class Cut:
    """Keys from ``key`` on lie above; ``rows`` and ``size`` are those below it. ``first``: the smallest key not below."""

    key: int
    rows: int
    size: int


def _search(bounds: list[int], width: int):
    """A function of a binary column: the number of bounds at or below each key."""
    packed = np.array([b.to_bytes(width, "big") for b in bounds] or [b""], f"S{width}")[:len(bounds)]

    @F.pandas_udf("int")
    def below(keys: pd.Series) -> pd.Series:
        if not len(packed):
            return pd.Series(np.zeros(len(keys), np.int32))
        return pd.Series(np.searchsorted(packed, np.array(keys.tolist(), packed.dtype), "right").astype(np.int32))

    return below


def place(keys: Column, cuts: list[Cut], width: int) -> Column:
    """The number of cuts at or below each key: the index of the range that a row belongs to."""
    return _search([c.key for c in cuts], width)(keys)


def splitters(keys: DataFrame, targets: list[float], tolerances: list[float], width: int,
              probes: int = PROBES) -> tuple[list[Cut], int, int]:
    """One cut for each target number of bytes, and all rows and bytes.

    ``keys`` has ``key`` (binary of ``width``) and ``size`` (long). A cut's bytes lie within the target's tolerance, or
    no boundary between two different keys is nearer to the target. Equal targets of an empty table give no cut.
    """
    total = keys.agg(F.count(F.lit(1)), F.sum("size"), F.min("key"), F.max("key")).first()
    rows, size = total[0], int(total[1] or 0)
    if not rows:
        return [], 0, 0
    number = lambda b: int.from_bytes(bytes(b), "big")
    found: dict[int, Cut] = {}
    #: Intervals still to be probed: first and last key in them, rows and bytes below.
    open_: list[tuple[int, int, int, int]] = [(number(total[2]), number(total[3]), 0, 0)]
    waiting: dict[int, list[int]] = {0: list(range(len(targets)))}
    ends = {0: Cut(number(total[2]), 0, 0), size: Cut(number(total[3]) + 1, rows, size)}
    while waiting:
        each = max(2, probes // len(open_))
        bounds: list[int] = []
        owner: list[int] = []
        for k, (low, high, _, _) in enumerate(open_):
            step = max(1, -(-(high - low + 1) // each))
            inner = [low + i * step for i in range(each) if low + i * step <= high] + [high + 1]
            if bounds and bounds[-1] == inner[0]:
                inner = inner[1:]
                owner[-1] = k
            bounds += inner
            owner += [k] * (len(inner) - 1) + [-1]
        mine = {i + 1 for i, k in enumerate(owner) if k >= 0}
        below = _search(bounds, width)
        cells = (keys.select(below("key").alias("cell"), "key", "size").groupBy("cell")
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b")))
        counted = {r["cell"]: r for r in cells.collect() if r["cell"] in mine}
        next_open: list[tuple[int, int, int, int]] = []
        next_waiting: dict[int, list[int]] = {}
        by_owner: dict[int, list[int]] = {}
        for cell in sorted(counted):
            by_owner.setdefault(owner[cell - 1], []).append(cell)
        for k, wanted in waiting.items():
            _, _, n, s = open_[k]
            edges = []  # cells in order: rows and bytes below each, and the cell
            for cell in by_owner[k]:
                edges.append((n, s, counted[cell]))
                n, s = n + counted[cell]["n"], s + int(counted[cell]["s"])
            starts = np.array([e[1] for e in edges])
            for t in wanted:
                i = max(0, int(np.searchsorted(starts, targets[t], "right")) - 1)
                low_n, low_s, cell = edges[i]
                high = Cut(number(cell["b"]) + 1, low_n + cell["n"], low_s + int(cell["s"]))
                low = Cut(number(cell["a"]), low_n, low_s)
                best = min((low, high), key=lambda c: abs(c.size - targets[t]))
                if abs(best.size - targets[t]) <= tolerances[t] or bytes(cell["a"]) == bytes(cell["b"]):
                    found[t] = best
                    continue
                item = (number(cell["a"]), number(cell["b"]), low_n, low_s)
                if item not in next_open:
                    next_open.append(item)
                next_waiting.setdefault(next_open.index(item), []).append(t)
        open_, waiting = next_open, next_waiting
    return [found[t] for t in range(len(targets))], rows, size

"""Packing by non-negative least squares over shallow length combinations.

Documents are cut into whole windows and a rest. A combination is up to three rests that fill the window exactly. How
often each is used is solved against the histogram of rests by non-negative least squares, rounded down, and what is left
is packed greedily, largest first, cutting a rest only where it closes a window. All of this sees counts of lengths, never
documents: its work depends on the window. Documents take their places by rank among the rests of their length.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

from .words import crc_of_ids, encoder, forget, in_batches

#: Columns that may enter the active set at once, and rounds at most; what is not solved by then is packed greedily.
ENTER = 48
ROUNDS = 60


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none), descending, that sum to the window; members are taken from ``lengths``."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    c = window - a - b
    use = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[use], b[use], c[use]
    keep = have[c] & (a < window)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def solve(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, where A counts each length in each combination.

    Active-set method: combinations with the greatest gain enter, least squares is solved on those present, and those
    that would turn negative leave. At most as many stay as there are lengths, so rounding down loses little.
    """
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    goal = histogram.astype(float).copy()
    goal[0] = 0
    active = np.zeros(len(combos), bool)
    left_for_good = np.zeros(len(combos), np.int32)

    def columns(which: np.ndarray) -> np.ndarray:
        matrix = np.zeros((len(goal), len(which)))
        for k in range(3):
            np.add.at(matrix, (combos[which, k], np.arange(len(which))), 1.0)
        matrix[0] = 0
        return matrix

    for _ in range(ROUNDS):
        met = np.zeros(len(goal))
        for k in range(3):
            np.add.at(met, combos[:, k], x)
        rest = goal - met
        rest[0] = 0
        gain = rest[combos].sum(1)
        gain[active] = -1
        gain[left_for_good > 2] = -1
        best = np.argsort(-gain, kind="stable")[:ENTER * 8]
        best = best[gain[best] > 0.5]
        if not len(best):
            break
        taken: set[int] = set()
        entering = []
        for j in best.tolist():  # combinations without a common length enter together
            own = set(combos[j].tolist()) - {0}
            if not own & taken:
                taken |= own
                entering.append(j)
            if len(entering) == ENTER:
                break
        active[entering] = True
        while True:
            which = np.flatnonzero(active)
            matrix = columns(which)
            gram = matrix.T @ matrix + 1e-8 * np.eye(len(which))
            z = np.linalg.solve(gram, matrix.T @ goal)
            if (z > 1e-9).all():
                x[:] = 0
                x[which] = z
                break
            now = x[which]
            bad = z <= 1e-9
            step = min(1.0, float(np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-12))))
            x[which] = now + step * (z - now)
            out = which[bad & (x[which] <= 1e-9)]
            if not len(out):
                out = which[bad]
            x[out] = 0
            active[out] = False
            left_for_good[out] += 1
            if not active.any():
                break
    return x


@dataclass(frozen=True)
class Run:
    """``count`` rests of length ``source`` from rank ``rank`` on: their tokens from ``skip`` to ``skip + length`` lie at
    ``offset`` of the sequences from ``sequence`` on, one each."""

    source: int
    rank: int
    count: int
    skip: int
    length: int
    sequence: int
    offset: int


class _Stock:
    """Rests of each length, as runs of ranks; cut rests come back as rests of another length."""

    def __init__(self, histogram: np.ndarray) -> None:
        self.runs = {n: [(n, 0, int(c), 0)] for n, c in enumerate(histogram) if n and c}
        self.count = {n: int(c) for n, c in enumerate(histogram) if n and c}

    def take(self, length: int, number: int, cut: int, sequence: int, offset: int) -> list[Run]:
        """Put ``number`` rests of ``length`` (their first ``cut`` tokens) at ``offset`` of as many sequences."""
        placed = []
        self.count[length] -= number
        while number:
            source, rank, have, skip = self.runs[length].pop()
            use = min(have, number)
            if use < have:
                self.runs[length].append((source, rank + use, have - use, skip))
            placed.append(Run(source, rank, use, skip, cut, sequence, offset))
            if cut < length:
                self.runs.setdefault(length - cut, []).append((source, rank, use, skip + cut))
                self.count[length - cut] = self.count.get(length - cut, 0) + use
            sequence += use
            number -= use
        return placed


def plan(histogram: np.ndarray, window: int, sequence: int = 0) -> tuple[list[Run], int]:
    """Runs that place every rest, and the number of sequences begun, from ``sequence`` on."""
    first, runs, stock = sequence, [], _Stock(histogram)
    combos = combinations(window, np.flatnonzero(histogram))
    repeats = np.floor(solve(combos, histogram) + 1e-6).astype(np.int64)

    def fill(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, cut in parts:
            runs.extend(stock.take(length, times, cut, sequence, offset))
            offset += cut
        sequence += times

    for j in np.argsort(-repeats, kind="stable"):
        own = [n for n in combos[j].tolist() if n]
        need = {n: own.count(n) for n in own}
        times = min([int(repeats[j]), *(stock.count.get(n, 0) // k for n, k in need.items())])
        if times > 0:
            fill([(n, n) for n in own], times)
    while any(stock.count.values()):
        free = {n: c for n, c in stock.count.items() if c}
        parts, room = [], window
        while room and free:
            fitting = [n for n in free if n <= room]
            length = max(fitting) if fitting else min(free)
            parts.append((length, min(length, room)))
            room -= min(length, room)
            free[length] -= 1
            if not free[length]:
                del free[length]
        own = [n for n, _ in parts]
        fill(parts, max(1, min(stock.count[n] // own.count(n) for n in own)))
    return runs, sequence - first


def tokenized(docs: DataFrame, tokenizer: str, end: int, window: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of each document with the end id, written once: part, doc, n, rest, rank of the rest in its part, whole windows
    of the part before, ids."""
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = encoder(tokenizer)
        tail = np.array([end], book.dtype).tobytes()
        part = TaskContext.get().partitionId()
        seen, whole = np.zeros(window, np.int64), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for piece in in_batches(texts):
                ids = [found + tail for found in book.encode(texts[piece])]
                sizes = np.array([len(i) // book.dtype.itemsize for i in ids], np.int64)
                rests = sizes % window
                ranks = np.empty(len(ids), np.int64)
                for k, rest in enumerate(rests.tolist()):
                    ranks[k] = seen[rest]
                    seen[rest] += 1
                windows = np.cumsum(sizes // window)
                yield pd.DataFrame({"part": part, "doc": batch["doc"].iloc[piece].astype("Int64"), "n": sizes,
                                    "rest": rests, "rank": ranks, "before": whole + windows - sizes // window,
                                    "wide": book.dtype.itemsize, "ids": ids})
                whole += int(windows[-1])

    path = shared_dir(spark, "token-ids")
    (docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
     .mapInPandas(run, "part int, doc long, n long, rest int, rank long, before long, wide int, ids binary")
     .write.option("compression", "zstd").parquet(path))
    return spark.read.parquet(path)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, window: int = 1024, text: str = "text",
         key: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row for each piece: ``key``, ``start`` in its document, ``length``, ``doc_tokens``, ``sequence_id`` and
    ``offset`` there, ``wide`` and ``ids`` (little-endian, ``wide`` bytes each), or with ``digest`` ``ids_crc32`` (the ids
    as 32-bit integers) instead of the last two.

    Every id lies in exactly one piece, every sequence is full but the last. A null text is a document of the end id
    alone; null keys are kept; repeated rows and ties are documents like any other; other columns are not read. Sequences
    of rests are numbered from 0, those of whole windows after them in part order. An empty table gives no piece.

    Ids are written once with ranks inside their part. Ranks over all parts come from counts by part and length, which
    are joined to the ids as one row for each part. The plan that places rests is bounded by the window.
    """
    spark = docs.sparkSession
    stored = tokenized(docs, tokenizer, end, window, text, key)
    counts = stored.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    histogram = np.zeros(window, np.int64)
    for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect():
        histogram[r["rest"]] = r["c"]
    runs, begun = plan(histogram, window)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
             .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"),
                                  F.sum("full").alias("full")))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.withColumn("whole", F.coalesce(F.sum("full").over(ahead), F.lit(0)) + begun).drop("full")
    joined = stored.join(bases, "part").select(
        "doc", "n", "rest", (F.col("rank") + F.col("bases")[F.col("rest")]).alias("place"),
        (F.col("whole") + F.col("before")).alias("whole"), "wide", "ids")

    ordered = sorted(runs, key=lambda r: (r.source, r.skip, r.rank))
    table = np.array([[r.source, r.rank, r.count, r.skip, r.length, r.sequence, r.offset] for r in ordered] or
                     np.empty((0, 7)), np.int64)
    held = spark.sparkContext.broadcast(table)  # bounded by the window, not by the documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        rows = held.value
        by_source = {int(s): rows[rows[:, 0] == s] for s in np.unique(rows[:, 0])}
        for batch in batches:
            out = []

            def add(doc, start: int, length: int, n: int, sequence: int, offset: int, wide: int, ids: bytes) -> None:
                own = ids[start * wide:(start + length) * wide]
                out.append((doc, start, length, n, sequence, offset, *([crc_of_ids(wide, own)] if digest else [wide, own])))

            for doc, n, rest, place, whole, wide, ids in zip(*[batch[c].tolist() for c in batch.columns]):
                for k in range(n // window):
                    add(doc, k * window, window, n, whole + k, 0, wide, ids)
                if rest:
                    own = by_source[rest]
                    for _, rank, _, skip, length, sequence, offset in own[
                            (own[:, 1] <= place) & (place < own[:, 1] + own[:, 2])].tolist():
                        add(doc, n - rest + skip, length, n, sequence + place - rank, offset, wide, ids)
            frame = pd.DataFrame(out, columns=[key, *names])
            frame[key] = frame[key].astype("Int64")
            yield frame

    names = ["start", "length", "doc_tokens", "sequence_id", "offset", *(["ids_crc32"] if digest else ["wide", "ids"])]
    kinds = {"wide": "int", "ids": "binary"}
    return joined.mapInPandas(run, ", ".join([f"`{key}` long", *(f"{name} {kinds.get(name, 'long')}" for name in names)]))

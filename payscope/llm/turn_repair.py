"""Repair of the order of roles in conversations by cheapest edits, found by divide and conquer in linear space.

The roles of a repaired conversation are nothing, or an optional system turn and then user and assistant in turns. Rows
are kept (cost 0), given another role (3) or deleted (4); empty user or assistant turns are inserted (3); a truncated
row that stays costs 3 more. Blank rows and repeats must go. The audit is the initials of the edits, and the cheapest
edits with the ASCII-least audit are taken.

Four states (nothing yet, after a system, a user, an assistant turn) make the cost vectors. To solve a stretch of rows
between two states, a forward vector of its first half and a backward vector of its second half meet in the middle; the
crossing with the least sum, and among those the least audit, is taken, and both halves are solved. Two audits that end
with the same row never differ by inserts at the end alone, so neither begins the other; the order among states is
therefore enough to compare them, and no audit is kept before the crossing is known.

A conversation is cut into segments of at most ``SEGMENT`` rows by a sorted exchange. What a segment costs between any
two states is a step like that of one row, so the same search over segments finds the states at their borders, and then
every segment is solved by itself. One conversation may hold most of the rows.

Nulls: a null role or text is one space; rows with a null conversation are one conversation; null turns come first.
Rows of equal turn are ordered by role and text; repeated rows are repeats of the first. An empty table gives an empty
result. Very long texts travel as rows, one at a time.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payscope.sources.tables import shared_dir

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a segment: a power of two that divides the numbers Spark gives to one partition's rows.
SEGMENT = 1024

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: The state after an inserted turn or a new role.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: step[p][q] = (cost, what orders audits from p), or None
Step = tuple


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    if initial in "ua" and (state == USER) == (initial == "a"):
        return NEXT[state]
    return None


def _step(code: str) -> Step:
    """All ways through one row: up to two inserts (three would end where one does), then one edit of the row."""
    extra = TRUNCATED if code.isupper() else 0
    table = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        now = state
        for inserts in range(3):
            ways = [(now, DELETE, "D")]
            if code != "x":
                ways.append((NEXT[now], REROLE + extra, "R"))
                if _kept(now, code.lower()) is not None:
                    ways.append((_kept(now, code.lower()), KEEP + extra, "K"))
            for after, cost, letter in ways:
                way = (INSERT * inserts + cost, "I" * inserts + letter)
                best[after] = min(best.get(after, way), way)
            now = NEXT[now]
        table.append(tuple(best.get(q) for q in range(4)))
    return tuple(table)


#: Initials of kept roles (o: any other), capital where the row is truncated; x: the row must go.
STEPS = {code: _step(code) for code in "suaoSUAOx"}
#: What must still be inserted at the end.
LAST = (((0, ""), None, None, None), (None, None, None, (2 * INSERT, "II")), (None, None, None, (INSERT, "I")),
        (None, None, None, (0, "")))
ANY_END = (START, ASSISTANT)


def forward(steps: list[Step], lo: int, hi: int, state: int) -> list[tuple[int, int]]:
    """Cost from ``state`` before step ``lo`` to each state after ``hi``, and the place of its least audit among them."""
    vector = [(FAR, 0)] * 4
    vector[state] = (0, 0)
    for step in steps[lo:hi]:
        found = []
        for q in range(4):
            ways = [(vector[p][0] + step[p][q][0], vector[p][1], step[p][q][1])
                    for p in range(4) if vector[p][0] < FAR and step[p][q] is not None]
            found.append(min(ways) if ways else None)
        order = sorted((f[1:], q) for q, f in enumerate(found) if f)
        place = {q: i for i, (_, q) in enumerate(order)}
        vector = [(f[0], place[q]) if f else (FAR, 0) for q, f in enumerate(found)]
    return vector


def backward(steps: list[Step], lo: int, hi: int, ends: tuple[int, ...]) -> list[int]:
    """Cost from each state before step ``lo`` to one of ``ends`` after ``hi``."""
    vector = [0 if s in ends else FAR for s in range(4)]
    for step in reversed(steps[lo:hi]):
        vector = [min((w[0] + vector[q] for q, w in enumerate(row) if w is not None and vector[q] < FAR), default=FAR)
                  for row in step]
    return vector


def crossings(steps: list[Step], start: int, ends: tuple[int, ...]) -> list[int]:
    """The state after each step on the cheapest way with the least audit."""
    states = [start] + [0] * len(steps)

    def solve(lo: int, hi: int, ends: tuple[int, ...]) -> None:
        if lo == hi:
            return
        middle = (lo + hi + 1) // 2
        ahead, rest = forward(steps, lo, middle, states[lo]), backward(steps, middle, hi, ends)
        states[middle] = min((c + r, place, s) for s, ((c, place), r) in enumerate(zip(ahead, rest)))[2]
        if middle < hi:
            solve(lo, middle, (states[middle],))
            solve(middle, hi, ends)

    solve(0, len(steps), ends)
    return states


@lru_cache(1 << 14)
def audit(codes: str, start: int = START, end: int | None = None) -> tuple[str, int]:
    """Audit and cost of a segment from ``start`` to ``end``, or to the end of the conversation where it is None."""
    steps = [STEPS[c] for c in codes] + ([LAST] if end is None else [])
    states = crossings(steps, start, ANY_END if end is None else (end,))
    ways = [step[p][q] for step, p, q in zip(steps, states, states[1:])]
    return "".join(w[1] for w in ways), sum(w[0] for w in ways)


def summary(codes: str) -> Step:
    """A segment as one step: cost, and the order of its audits, from each state to each."""
    steps = [STEPS[c] for c in codes]
    return tuple(tuple((c, place) if c < FAR else None for c, place in forward(steps, 0, len(steps), p)) for p in range(4))


def _space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """All rows in order, numbered, in a table of the shared folder. Rows equal in everything are spread."""
    spark = turns.sparkSession
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                        _space(F.col(f"`{role}`")).alias("role"), _space(F.col(f"`{text}`")).alias("text"))
    order = ["conv", "turn", "role", "text", "spread"]
    path = shared_dir(spark, "turns")
    (rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
     .drop("spread").withColumn("pos", F.monotonically_increasing_id()).write.parquet(path))
    return spark.read.parquet(path)


class Repair:
    """Faults, edits and repaired rows of all conversations of ``turns``; the rows and audits are tables of the shared
    folder, made when the object is."""

    def __init__(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv = conv
        self.rows = _ordered(turns, conv, turn, role, text)
        spark, path = turns.sparkSession, shared_dir(turns.sparkSession, "audits")
        self._audits(self._segments()).write.parquet(path)
        self.audits = spark.read.parquet(path)

    def _segments(self) -> DataFrame:
        """A row for each segment: its rows' codes and initials, and counts of faults.

        The first of equal rows is found by one aggregation; its number is unique, so no conversation is a hot key when
        the answer returns to the rows.
        """
        bare = F.rtrim(F.col("text"), F.lit(SPACES))
        initial = F.left("role", F.lit(1))
        narrow = self.rows.select(
            "conv", "pos", "role", F.sha2("text", 256).alias("digest"), (bare == "").alias("is_blank"),
            (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
        firsts = narrow.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select(
            "pos", F.lit(True).alias("is_first"))
        fault = (F.when(F.col("is_blank"), "blank").when(F.col("is_first").isNull(), "duplicate")
                 .when(F.col("is_cut"), "truncated"))
        marked = narrow.join(firsts, "pos", "left").withColumn("fault", fault)
        code = (F.when(F.col("fault").isin("blank", "duplicate"), "x")
                .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
        count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
        listed = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"), "initial")))
        joined = lambda name: F.array_join(F.transform("listed", lambda r: r[name]), "").alias(name)
        return (marked.groupBy("conv", F.shiftright("pos", SEGMENT.bit_length() - 1).alias("segment"))
                .agg(listed.alias("listed"), count("blank"), count("duplicate"), count("truncated"))
                .select("conv", F.col("listed")[0]["pos"].alias("pos"), joined("code"), joined("initial"), "blank",
                        "duplicate", "truncated"))

    def _audits(self, segments: DataFrame) -> DataFrame:
        """Segments with their states at both ends, audit and cost."""
        along = Window.partitionBy("conv").orderBy("pos")
        ends = segments.withColumns({
            "before": F.lag(F.right("initial", F.lit(1))).over(along), "more": F.lead("pos").over(along).isNotNull()})
        pairs = F.concat(F.coalesce("before", F.lit("")), "initial")
        ends = ends.withColumn("illegal", (F.length(pairs) - 1 - F.regexp_count(pairs, F.lit("(?=su|ua|au)"))).cast("long"))
        path = shared_dir(segments.sparkSession, "segments")
        ends.write.parquet(path)
        ends = segments.sparkSession.read.parquet(path)
        several = ends.where(F.col("before").isNotNull() | F.col("more")).select("conv", "pos", "code", "more")

        def borders(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("pos")
            steps = [summary(c) for c in group["code"]] + [LAST]
            states = crossings(steps, START, ANY_END)
            return pd.DataFrame({"pos": group["pos"], "enter": states[:-2], "leave": states[1:-1]})

        known = several.groupBy("conv").applyInPandas(borders, "pos long, enter int, leave int")

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                solved = [audit(code, enter, leave if more else None) for code, enter, leave, more in zip(
                    batch["code"], batch["enter"], batch["leave"], batch["more"])]
                yield batch.assign(audit=[s[0] for s in solved], cost=[s[1] for s in solved]).drop(columns=["code", "more"])

        joined = ends.join(known, "pos", "left").select(
            F.col("conv").cast("string"), "pos", "code", "more", F.coalesce("enter", F.lit(START)).alias("enter"),
            F.coalesce("leave", F.lit(START)).alias("leave"), "blank", "duplicate", "truncated", "illegal")
        solved = joined.mapInPandas(solve, "conv string, pos long, enter int, leave int, blank long, duplicate long, "
                                           "truncated long, illegal long, audit string, cost long")
        return solved.withColumn("conv", F.col("conv").cast(self.rows.schema["conv"].dataType))

    def report(self) -> DataFrame:
        """A row for each conversation: gaps in its turns, counts of faults, cost and audit. The audit of a conversation
        is one string; its parts are a segment's each."""
        turns = self.rows.groupBy("conv", "turn").agg(F.count(F.lit(1))).groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        parts = F.array_sort(F.collect_list(F.struct("pos", "audit")))
        edits = self.audits.groupBy(F.col("conv").alias("of")).agg(
            *sums, F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        return turns.join(edits, F.col("conv").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("conv", self.conv)

    def repaired(self, together: bool = False) -> DataFrame:
        """The rows of the repaired conversations: ``pos`` and ``nth`` order them. Audits and rows meet by one exchange,
        by segment, or by conversation where ``together``; each partition is in order then."""
        part = F.shiftright("pos", SEGMENT.bit_length() - 1)
        none = F.lit(None).cast("string")
        both = self.rows.select("conv", "pos", F.lit(1).alias("tag"), "role", "text", F.lit(0).alias("enter")).unionByName(
            self.audits.select("conv", "pos", F.lit(0).alias("tag"), none.alias("role"), F.col("audit").alias("text"), "enter"))
        dealt = both.repartition("conv") if together else both.repartition("conv", part)
        rows = dealt.sortWithinPartitions("conv", "pos", "tag").withColumn("conv", F.col("conv").cast("string"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            edits, last, at, state, where = "", 0, 0, START, (None, 0, 0)
            for batch in batches:
                out: list[tuple] = []

                def insert() -> None:
                    nonlocal at, state, where
                    while at < len(edits) and edits[at] == "I":
                        at, state = at + 1, NEXT[state]
                        out.append((*where, NAMES[state], ""))
                        where = (where[0], where[1], where[2] + 1)

                for conv, pos, tag, role, text, enter in zip(*(batch[c].tolist() for c in batch.columns)):
                    if tag == 0:
                        edits, last, at, state = text, len(text.rstrip("I")), 0, enter
                        continue
                    where = (conv, pos, 0)
                    insert()
                    letter, at = edits[at], at + 1
                    if letter != "D":
                        if letter == "R":
                            state = NEXT[state]
                            role = NAMES[state]
                        else:
                            state = _kept(state, role[:1])
                        out.append((*where, role, text))
                        where = (*where[:2], where[2] + 1)
                    if at == last:
                        insert()
                yield pd.DataFrame(out, columns=["conv", "pos", "nth", "role", "text"])

        made = rows.mapInPandas(run, "conv string, pos long, nth int, role string, text string")
        return made.withColumn("conv", F.col("conv").cast(self.rows.schema["conv"].dataType))

    def digests(self) -> DataFrame:
        """SHA-256 of each repaired conversation that has rows, as ``role:text`` lines. A hash is one chain: a
        conversation's rows stream through one task, a batch at a time."""
        import hashlib

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, chain, begun = None, None, False
            for batch in batches:
                done = []
                for conv, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                    if not begun or conv != current:
                        if begun:
                            done.append((current, chain.hexdigest()))
                        current, chain, begun = conv, hashlib.sha256(), True
                    else:
                        chain.update(b"\n")
                    chain.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
            if begun:
                yield pd.DataFrame([(current, chain.hexdigest())], columns=["conv", "repaired_sha256"])

        rows = self.repaired(together=True)
        made = rows.withColumn("conv", F.col("conv").cast("string")).mapInPandas(run, "conv string, repaired_sha256 string")
        return made.withColumn("conv", F.col("conv").cast(rows.schema["conv"].dataType))


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn``: dropped, emptied, without stops, repeated, or said by the user."""
    kind = F.crc32(F.concat(_space(F.col("conv_id")), F.lit(":"), _space(F.col("turn"))).cast("binary")) % 20
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    rows = turns.select("conv_id", "turn", _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"),
                        kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                       .alias("copy")).drop("copy")

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from payscope.llm import queries, ranked_search, source_schedule, turn_repair
from tests.conftest import connect, duck_rows, rows_of

LONG = "Word " * 40_000


def agree(spark, folder, name):
    want = duck_rows(connect(folder), queries.STATEMENTS[name])
    assert rows_of(queries.QUERIES[name](spark, str(folder))) == want
    return want


def stored(tmp_path, **tables):
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        part = next((tmp_path / name).glob("part-*.parquet"))
        part.rename(tmp_path / f"{name}.parquet")
    return tmp_path


# --- repair of turns

def every_audit(codes):
    """All results of all edits with few inserts, tried one by one."""
    best = {}
    for letters in itertools.product("DKR", repeat=len(codes)):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            state, cost, audit = "", 0, ""
            for i in range(len(codes) + 1):
                for _ in range(gaps[i]):
                    state += "a" if state.endswith("u") else "u"
                    cost, audit = cost + 3, audit + "I"
                if i == len(codes):
                    break
                code, letter = codes[i], letters[i]
                if code == "x" and letter != "D":
                    state = None
                    break
                audit += letter
                if letter == "D":
                    cost += 4
                    continue
                cost += 3 if code.isupper() else 0
                if letter == "K":
                    state += code.lower()
                else:
                    state, cost = state + ("a" if state.endswith("u") else "u"), cost + 3
            if state is None:
                continue
            rest = state[1:] if state.startswith("s") else state
            if state == "" or (rest and rest == "ua" * (len(rest) // 2)):
                found = (cost, audit)
                best = min(best or found, found)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_audits_are_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(12):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 5)))
        audit, cost = turn_repair.audit(codes)
        assert (cost, audit) == every_audit(codes), codes


def test_segments_join_to_the_whole():
    """Any cut of a conversation into segments gives the audit of the whole."""
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(rng.choice("suaoSUAOxua") for _ in range(rng.randrange(2, 60)))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randrange(1, 6))))
        parts = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)])]
        steps = [turn_repair.summary(p) for p in parts] + [turn_repair.LAST]
        states = turn_repair.crossings(steps, turn_repair.START, turn_repair.ANY_END)
        solved = [turn_repair.audit(p, states[i], states[i + 1] if i + 1 < len(parts) else None) for i, p in enumerate(parts)]
        whole = turn_repair.audit(codes)
        assert ("".join(a for a, _ in solved), sum(c for _, c in solved)) == whole


TURNS = "conv_id long, turn long, role string, text string, pos long, conv string"


def turns_of(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]),
             rng.choice(["Yes.", "No!", "and", "", " \t", None, "Fine. ", "漢字。", "Ünï?\n", "same."]), 7, "x")
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", f"null conversation {t}.", 1, "y") for t in range(4)] + [(None, None, None, None, None, None)] * 3
    rows += [(50, None, "user", "no turn.", 1, "y"), (50, 3, "assistant", LONG, 1, "y"), (50, 3, "assistant", LONG, 1, "y"),
             (51, 9, "usher", "u for user?", 1, "y"), (-1, -5, "user", "below zero.", 1, "y"), (-1, 4, "assistant", "gap.", 1, "y")]
    rows += [(60, t % 700, ("user", "assistant", "assistant")[t % 3], f"long talk {t % 500}." if t % 11 else "cut", 0, "h")
             for t in range(1500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize("segment", [8, 1024])
def test_repair_query_equals_statement(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    want = agree(spark, stored(tmp_path, conversations=turns_of(spark)), "op12_hirschberg_repair")
    assert sum(want.values()) == 45 and any(len(str(r)) > 1500 for r in want)


def test_repair_of_empty_table(spark, tmp_path):
    assert not agree(spark, stored(tmp_path, conversations=turns_of(spark).where("false")), "op12_hirschberg_repair")


def test_repaired_rows_do_not_depend_on_the_exchange(spark):
    repair = turn_repair.Repair(turns_of(spark))
    one, other = (rows_of(repair.repaired(together=t)) for t in (True, False))
    assert one == other
    roles = (repair.repaired().groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "nth", "role"))).alias("r"))
             .select(F.array_join(F.transform("r", lambda x: F.left(x["role"], F.lit(1))), "").alias("r")).collect())
    assert roles and all(__import__("re").fullmatch("s?(ua)+", r["r"]) for r in roles)


# --- mixing

def brute_schedule(blocks):
    """Van der Corput points, one after another, mapped through cumulative weights; slots ranked by source."""
    cells = sum(blocks)
    bits = max(1, (max(cells - 1, 0)).bit_length())
    borders = list(itertools.accumulate(blocks))
    out, used = {}, [0] * len(blocks)
    for i in range(1 << bits):
        point = sum(1 << (bits - 1 - b) for b in range(bits) if i >> b & 1)
        owner = next((k for k, edge in enumerate(borders) if point < edge), None)
        if owner is not None:
            out[(owner, used[owner])] = i
            used[owner] += 1
    return out


@pytest.mark.parametrize("blocks", [[1], [3], [5, 0, 7, 1], [100, 3, 41, 9], [0, 0, 2]])
def test_schedule_equals_points_tried_one_by_one(spark, monkeypatch, blocks):
    monkeypatch.setattr(source_schedule, "CELLS", 8)
    cells = sum(blocks)
    ends = list(itertools.accumulate(blocks))
    rows = [(k, b, e - b, e, max(1, max(cells - 1, 0).bit_length())) for k, (b, e) in enumerate(zip(blocks, ends))]
    plan = spark.createDataFrame(rows, "no int, blocks long, first long, end long, bits int")
    got = {(r["no"], r["r"]): r["slot"] for r in source_schedule.schedule(plan).collect()}
    assert got == brute_schedule(blocks)


def test_mix_query_on_edge_documents(spark, tmp_path, edge_docs, monkeypatch):
    monkeypatch.setattr(source_schedule, "LINE_ROWS", 3)
    agree(spark, stored(tmp_path, documents=edge_docs), "op13_source_schedule")


def test_mix_of_empty_tables_and_texts(spark, tmp_path, no_docs, edge_docs):
    folder = tmp_path / "none"
    folder.mkdir()
    assert not agree(spark, stored(folder, documents=no_docs), "op13_source_schedule")
    folder = tmp_path / "blank"
    folder.mkdir()
    want = agree(spark, stored(folder, documents=edge_docs.withColumn("text", F.lit(" \n"))), "op13_source_schedule")
    assert sum(want.values()) == edge_docs.count()


def test_mix_pieces_fill_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = source_schedule.mix(docs)
    plan = made.plan.collect()
    taken = {r["source"]: r["n"] for r in made.pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    for row in plan:
        assert taken.get(row["source"], 0) == row["cut"] and abs(row["cut"] - row["target"]) <= 0.5
    assert abs(sum(r["target"] for r in plan) - 1.5 * sum(r["source_size"] for r in plan)) < 1e-6
    full = made.pieces.groupBy("slot").agg(F.sum("length").alias("n"), F.countDistinct("source").alias("s")).collect()
    assert all(r["s"] == 1 and r["n"] <= source_schedule.BLOCK for r in full)
    assert sum(r["n"] < source_schedule.BLOCK for r in full) <= len(plan)
    assert rows_of(made.taken) == rows_of(source_schedule.mix(docs).taken)
    # every stretch of the schedule holds the sources nearly in proportion
    slots = [r["no"] for r in made.schedule.orderBy("slot").collect()]
    for k in range(len(plan)):
        for n in (len(slots) // 4, len(slots) // 2):
            assert abs(slots[:n].count(k) / n - slots.count(k) / len(slots)) < 0.05


# --- search

def items_of(spark):
    rows = [(1, "Naïve ünïcode 漢字 a b c", "x", 1), (2, "the same line the same the", "x", 2), (2, "word", "x", 3), (3, None, "x", 4),
            (4, "", None, 5), (None, "It's they'll 345 6 tag", None, 6), (5, "zzzz nothing of this", "y", 7), (6, "\x1c é É E", "z", 8)]
    return spark.createDataFrame(rows, "item_id long, text string, key string, bundle int")


@pytest.mark.parametrize("small", [False, True])
def test_search_query_on_edge_documents(spark, tmp_path, edge_docs, monkeypatch, small):
    if small:
        for name, value in (("SHARD_DOCS", 2), ("BUNDLE_ITEMS", 3), ("BLOCK_TERMS", 9), ("STRETCH", 16)):
            monkeypatch.setattr(ranked_search, name, value)
    agree(spark, stored(tmp_path, documents=edge_docs, benchmark=items_of(spark)), "op11_pipelined_search")


def test_search_drops_accumulators_without_loss(spark, tmp_path, monkeypatch):
    """Shards with far more documents than are asked for, so that most accumulators are dropped on the way."""
    for name in ("documents", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.01/{name}.parquet")
    agree(spark, tmp_path, "op11_pipelined_search")


def test_search_of_empty_tables(spark, tmp_path, no_docs, edge_docs):
    for i, (docs, items) in enumerate([(no_docs, items_of(spark)), (edge_docs, items_of(spark).where("false"))]):
        folder = tmp_path / str(i)
        folder.mkdir()
        assert not agree(spark, stored(folder, documents=docs, benchmark=items), "op11_pipelined_search")

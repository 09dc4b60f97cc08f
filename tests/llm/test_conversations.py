"""Preference formatting against a plain version, and the DuckDB statements and the pipeline on test data."""
from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from payscope.llm import preferences, queries
from tests.conftest import TESTDATA, connect, duck_rows, rows_of


def _shown(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def _spans(turns):
    found, at = [], 0
    for role, text in turns:
        start = at + 13 + len(role)
        at = start + len(text) + 11
        if role == "assistant":
            found.append((start, at))
    return found


def test_pairs_share_their_longest_prefix(spark):
    rng, rows = random.Random(4), []
    for pair in range(80):
        shared = [(k, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b b", "", None, "é🎉", "x" * 5000]))
                  for k in range(rng.randrange(0, 5))]
        for side in (True, False):
            own = shared + [(len(shared) + k, rng.choice(["user", "assistant"]), rng.choice(["same", "p", "q"]))
                            for k in range(rng.randrange(0, 4))]
            rows += [(pair, side, k, role, text, "n", "c") for k, role, text in own]
    rows += [(None, True, 0, "user", "lost", "n", "c"), (90, None, 0, "user", "lost", "n", "c"), (91, True, None, "user", "only", "n", "c"),
             (92, True, 0, "user", "t", "n", "c"), (92, True, 0, "user", "t", "n", "c"), (92, False, 0, "user", "t", "n", "c")]
    turns = spark.createDataFrame(rows, "pair_id long, is_chosen boolean, turn long, role string, text string, n string, c string")
    sides = defaultdict(list)
    for pair, side, k, role, text, *_ in rows:
        if pair is not None and side is not None:
            sides[pair, side].append((k is not None, k or 0, role or "", text or ""))
    wanted = {}
    for pair in {p for p, _ in sides}:
        c, r = [[x[2:] for x in sorted(sides[pair, s])] for s in (True, False)]
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        wanted[pair] = (n, _shown(c[:n]), _shown(c[n:]), _shown(r[n:]), _spans(c[n:]), _spans(r[n:]))
    found = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans],
                         [tuple(s) for s in r.rejected_spans]) for r in preferences.format_pairs(turns.repartition(5)).collect()}
    assert found == wanted
    assert preferences.format_pairs(turns.where("false")).count() == 0


def test_partner_endings_of_odd_tables(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (4, None, None, None), (None, 0, "user", "lost"),
            (6, 0, "user", "d"), (6, 0, "user", "d"), (7, 2, "assistant", "e")]
    turns = preferences.with_partner_endings(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    rejected = Counter((r.pair_id, r.turn, r.role, r.text) for r in turns.where("not is_chosen").collect())
    assert rejected == Counter([(0, 0, "user", "a"), (0, 1, "user", "c"), (1, 0, "assistant", "b"), (6, 0, "assistant", "e"),
                                (7, 2, "user", "d")])


@pytest.mark.parametrize("name", sorted(queries.STATEMENTS))
def test_query_equals_its_statement(spark, name):
    connection = connect(TESTDATA)
    assert rows_of(queries.QUERIES[name](spark, str(TESTDATA))) == duck_rows(connection, queries.STATEMENTS[name])


def test_pipeline_stages_take_effect(spark):
    from .test_documents import _bare, _quality

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "packing"]
    texts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(TESTDATA))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts.append({r.doc_id: r for r in docs.collect()})
        docs = spark.createDataFrame(list(texts[-1].values()), docs.schema)
    good, lines, single = texts
    assert all(not _quality(r.text)[5] for r in good.values()) and set(lines) == set(good) > set(single)
    sites = defaultdict(set)
    for r in good.values():
        for line in map(_bare, r.text.split("\n")):
            sites[line].add(r.source)
    left = Counter(line for r in lines.values() for line in map(_bare, r.text.split("\n"))
                   if len(sites[line]) >= 4 and len(line.split()) >= 3)
    assert left and max(left.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values())
    pieces = corpus_pipeline.run(spark, str(TESTDATA)).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == set(single)
    assert all(tokens[p.doc_id] == p.doc_tokens for p in pieces)

"""Operators that encode: token files, distinct-word BPE, packing, and the words they share."""
from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from payscope.llm import bpe, packing, queries, token_store, words
from payscope.sources.tables import shared_dir
from tests.conftest import TESTDATA

from .conftest import NASTY

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)  # as it is: added tokens in a text are found
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_librarys_ids(library, monkeypatch):
    monkeypatch.setattr(words, "KEPT_WORDS", 60)  # also past what is kept
    book = words.WordEncoder(JSON)
    every = [*NASTY, None, "a<|endoftext|>b", "<|endoftext|><|endoftext|> <|endoftext|", "x  <|endoftext|>  y " * 50, *(chr(c) + " a" + chr(c) + " " + chr(c) + "b" for c in range(1, 0x3100, 7))]
    for _ in range(2):
        for text, ids in zip(every, book.encode(every)):
            assert np.frombuffer(ids, book.dtype).tolist() == library(text), repr(text)[:60]


def test_token_files_read_back(spark, edge_docs, no_docs, library):
    store = shared_dir(spark, "test-store")
    token_store.write(edge_docs, store, JSON, end=2)
    found = token_store.read(spark, store).collect()
    texts = edge_docs.select("doc_id", "text").collect()
    assert (Counter((r.doc_id, tuple(np.frombuffer(r.ids, f"<u{r.wide}").tolist())) for r in found)
            == Counter((r.doc_id, (*library(r.text), 2)) for r in texts))
    ordered, at = sorted(found, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert token_store.read_one(spark, store, 7) == [*library(NASTY[7]), 2]
    with pytest.raises(KeyError):
        token_store.read_one(spark, store, 999)
    index = spark.read.parquet(f"{store}/index")
    known = spark.read.parquet(f"{store}/dictionary").first()
    assert index.select("dictionary").distinct().first()[0] == known["hash"] == hashlib.sha256(known["bytes"]).hexdigest()
    empty = shared_dir(spark, "test-store")
    token_store.write(no_docs, empty, JSON, end=2)
    assert token_store.read(spark, empty).count() == 0


def test_token_files_query(spark, library):
    texts = dict(spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in queries.token_files(spark, str(TESTDATA)).collect()}
    at = 0
    for key in sorted(texts):
        ids = [*library(texts[key]), 2]
        assert (rows[key].start, rows[key].n_tokens, rows[key].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_distinct_word_bpe_is_the_librarys(spark, edge_docs, no_docs):
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS),
                              special_tokens={})

    def expected(text):
        ids = whole.encode_ordinary(text or "")
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest())

    encoded = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN)
    found = Counter(tuple(r) for r in bpe.per_document(encoded, spark, RANKS).collect())
    assert found == Counter((r.doc_id, *expected(r.text)) for r in edge_docs.select("doc_id", "text").collect())
    assert bpe.per_document(bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), spark, RANKS).count() == 0
    texts = dict(spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: tuple(r)[1:] for r in queries.bpe_round_trip(spark, str(TESTDATA)).collect()}
    assert rows == {k: expected(t) for k, t in texts.items()}


def test_varints_and_strings():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1])
    assert bpe.from_varints(bpe.to_varints(values)).tolist() == values.tolist()
    assert bpe.from_varints(bpe.to_varints(values[:0])).tolist() == []
    items = [b"", b"a\0b", "ü".encode(), b""]
    assert bpe.unpack_strings(bpe.pack_strings(items)) == items


def _placed(runs, histogram, window):
    """Every token of every rest, once, and every sequence filled without gaps."""
    held = defaultdict(list)
    for r in runs:
        for k in range(r.count):
            held[r.sequence + k].append((r.offset, r.length, r.source, r.rank + k, r.skip))
    rests = defaultdict(list)
    short = 0
    for pieces in held.values():
        at = 0
        for offset, length, source, rank, skip in sorted(pieces):
            assert offset == at and length > 0
            at += length
            rests[source, rank].append((skip, length))
        assert at <= window
        short += at < window
    assert short <= 1
    assert len(rests) == histogram.sum()
    for (source, rank), parts in rests.items():
        at = 0
        for skip, length in sorted(parts):
            assert skip == at
            at += length
        assert at == source and rank < histogram[source]
    return len(held)


@pytest.mark.parametrize("case", ["random", "hot", "one", "few", "none", "halves"])
def test_plan_places_every_rest_once(case):
    window, rng = 64, np.random.default_rng(3)
    histogram = np.zeros(window, np.int64)
    if case in ("random", "hot"):
        histogram[1:] = rng.integers(0, 30, window - 1)
    if case == "hot":
        histogram[41] += 700
    if case == "one":
        histogram[37] = 1
    if case == "few":
        histogram[[3, 50]] = 5, 2
    if case == "halves":
        histogram[32] = 10
    runs, begun = packing.plan(histogram, window)
    assert _placed(runs, histogram, window) == begun == -(-int((histogram * np.arange(window)).sum()) // window)


def test_least_squares_finds_an_exact_answer():
    histogram = np.zeros(33, np.int64)
    for combo, times in (((20, 12), 7), ((10, 11, 11), 5), ((30, 2), 9)):
        for n in combo:
            histogram[n] += times
    combos = packing.combinations(32, np.flatnonzero(histogram))
    x = packing.solve(combos, histogram)
    met = sum(np.bincount(combos[:, k], x, 33) for k in range(3))
    assert (x >= 0).all() and np.allclose(met[1:], histogram[1:], atol=1e-3)


def test_pieces_hold_every_id_once(spark, edge_docs, no_docs, library):
    rows = packing.pack(edge_docs, JSON, end=0, window=1024).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, f"<u{r.wide}").tolist()
        assert len(ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
    assert sorted(sequences) == list(range(len(sequences)))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        short += at < 1024
        assert at <= 1024
    assert short <= 1
    wanted = defaultdict(list)
    for r in edge_docs.select("doc_id", "text").collect():
        wanted[r.doc_id].append([*library(r.text), 0])
    for key, whole in wanted.items():
        assert (Counter(i for _, ids, _ in docs[key] for i in ids) == Counter(i for ids in whole for i in ids))
        if len(whole) == 1:
            assert [i for _, ids, _ in sorted(docs[key]) for i in ids] == whole[0]
            assert {n for _, _, n in docs[key]} == {len(whole[0])}
    assert packing.pack(no_docs, JSON).count() == 0


def test_digests_are_those_of_the_ids(spark, edge_docs):
    def both(rows_of):
        whole, digests = rows_of(False).collect(), rows_of(True).collect()
        columns = [c for c in digests[0].__fields__ if c != "ids_crc32"]
        ids = [np.frombuffer(r.ids, f"<u{r.wide}") for r in whole]
        assert (Counter((*(r[c] for c in columns), crc(i)) for r, i in zip(whole, ids))
                == Counter((*(r[c] for c in columns), r.ids_crc32) for r in digests))

    store = shared_dir(spark, "test-store")
    token_store.write(edge_docs, store, JSON, end=2)
    both(lambda digest: token_store.read(spark, store, digest=digest))
    both(lambda digest: packing.pack(edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"]), JSON, digest=digest))


def test_strings_of_plain_words_are_cut_at_every_word(library):
    letters = ["a", "Z", "é", "中", "5", "!", "'", "\n", "\t", " ", "\u0085", "\x1c", "​", "́", "<", "|"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice([*letters, " ", " ", " "], size)) for size in rng.integers(0, 40, 3000)]
    book = words.WordEncoder(JSON)
    for text, ids in zip(texts, book.encode(texts)):
        assert np.frombuffer(ids, book.dtype).tolist() == library(text), repr(text)
        assert "".join(words.space_led_words(text)) == text

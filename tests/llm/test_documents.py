"""Operators over documents against brute force."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from payscope.llm import histogram, line_spread, masked_lm, piecewise, quality, queries, sharding, simhash
from tests.conftest import TESTDATA

from .conftest import NASTY


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# shards

def test_shards_are_equal_in_bytes_and_gapless(spark, edge_docs, no_docs):
    rows = queries.histogram_shards(spark, str(TESTDATA)).collect()
    texts = dict(pairs(spark.read.parquet(f"{TESTDATA}/documents.parquet")))
    assert {r.doc_id: r.size for r in rows} == {k: len(t.encode()) + 8 for k, t in texts.items()}
    bytes_, slots = Counter(), defaultdict(list)
    for r in rows:
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    largest = max(r["size"] for r in rows)
    assert max(bytes_.values()) - sum(bytes_.values()) / 24 <= largest
    edge = sharding.shard(edge_docs, 3).select("row.doc_id", "row.text", "row.row", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in edge) == Counter(pairs(edge_docs))
    assert len({(r.shard, r.slot) for r in edge}) == len(edge)
    assert sharding.shard(no_docs, 3).count() == 0


def test_equal_texts_stay_together_where_sizes_allow(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 400).alias("text"))
    found = sharding.shard(docs, 8, tolerance=0.02).select("row.text", "shard").distinct().groupBy("text").count()
    assert found.where("count > 1").count() == 0


def test_one_group_larger_than_a_shard_is_cut(spark):
    docs = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"),
                                    F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    sizes = [r[1] for r in sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 24


def test_splitters_count_exactly(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(0, 50, 300)] + [17] * 200 + [2**62, -2**62]
    keys = spark.createDataFrame([(v, 1 + abs(v) % 9) for v in values], "v long, size long").select(
        histogram.sortable(F.col("v")).alias("key"), "size")
    total = sum(1 + abs(v) % 9 for v in values)
    cuts, rows, size = histogram.splitters(keys, [total * k / 5 for k in range(1, 5)], [0.0] * 4, 8, probes=16)
    assert (rows, size) == (len(values), total)
    for k, cut in enumerate(cuts, 1):
        below = [v for v in values if v + 2**63 < cut.key]
        assert (len(below), sum(1 + abs(v) % 9 for v in below)) == (cut.rows, cut.size)
        reach = [sum(1 + abs(w) % 9 for w in values if w < v) for v in set(values)] + [total]
        assert abs(cut.size - total * k / 5) == min(abs(r - total * k / 5) for r in reach)


# piecewise hashing

def test_likeness_falls_with_edits(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(800))
    near, far = text[:2000] + "CHANGED" + text[2050:], " ".join(f"other{i * 31 % 977}" for i in range(800))
    prints = [piecewise.fingerprint(t) for t in (text, text, near, far)]
    assert prints[0] == prints[1]
    got = spark.createDataFrame([(prints[0], p) for p in prints], "a string, b string").select(
        piecewise.likeness(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == got[1][0] == 1.0 and got[2][0] > 0.7 and got[3][0] < 0.4


def test_signatures_cover_whole_texts_in_bounds():
    for text in [*NASTY, None, "ab" * 5000]:
        block, first, second = piecewise.fingerprint(text).split(":")
        assert len(first) <= piecewise.PIECES + 1 and len(second) <= len(first) and int(block) % 3 == 0
    long = "".join(chr(97 + i * i % 26) for i in range(3 * piecewise.STRETCH // 2))
    assert piecewise.fingerprint(long) != piecewise.fingerprint(long[:-1] + "!")


def test_next_document_by_key(spark, edge_docs, no_docs):
    rows = piecewise.compared_with_edit_and_next(edge_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in pairs(edge_docs))
    unique = spark.createDataFrame([(i * 3 - 20, t, 1) for i, t in enumerate(NASTY)], "doc_id long, text string, key int")
    found = {r.doc_id: r for r in piecewise.compared_with_edit_and_next(unique.repartition(5)).collect()}
    texts = sorted((i * 3 - 20, t) for i, t in enumerate(NASTY))
    for (key, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        changed = piecewise.edited(text, following)
        assert (found[key].n_chars, found[key].fingerprint, found[key].edited_fingerprint, found[key].next_fingerprint) == (
            len(text), piecewise.fingerprint(text), piecewise.fingerprint(changed), piecewise.fingerprint(following))
    assert piecewise.compared_with_edit_and_next(no_docs).count() == 0


def plain_fingerprint(text):
    """One byte after the other: the hash of the last seven bytes rolls on, and a piece ends where its block size says."""
    data, rolled, mixed = text.encode("utf-8", "surrogatepass"), 0, []
    for i, byte in enumerate(data):
        rolled = (rolled * 0x01000193 + byte) % 2 ** 32
        if i >= 7:
            rolled = (rolled - data[i - 7] * pow(0x01000193, 7, 2 ** 32)) % 2 ** 32
        h = (rolled ^ rolled >> 15) * 0x85EBCA6B % 2 ** 32
        mixed.append(h ^ h >> 13)

    def pieces(block):
        found, piece = [], b""
        for i, h in enumerate(mixed):
            piece += data[i:i + 1]
            if h % block == block - 1:
                found.append(piece)
                piece = b""
        return found, [piece] if piece else []

    block = 3
    while len(pieces(block)[0]) > 64:
        block *= 2
    signs = ["".join(piecewise.ALPHABET[zlib.crc32(x) // 32 % 64] for x in sum(pieces(b), [])) for b in (block, 2 * block)]
    return f"{block}:{signs[0]}:{signs[1]}"


def plain_likeness(a, b):
    def alike(s, t):
        line = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(t, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return 1.0 - line[-1] / max(len(s), len(t)) if s or t else 1.0

    (p, *first), (q, *second) = a.split(":"), b.split(":")
    if p == q:
        return max([alike(first[0], second[0])] + [alike(first[1], second[1])] * (min(len(first[1]), len(second[1])) > 1))
    if int(p) == 2 * int(q):
        return alike(first[0], second[1])
    return alike(first[1], second[0]) if 2 * int(p) == int(q) else 0.0


def test_fingerprints_by_brute_force(spark):
    """The whole query against a rolling hash byte by byte and a plain edit distance."""
    texts = sorted(pairs(spark.read.parquet(f"{TESTDATA}/documents.parquet")))
    got = {r.doc_id: r for r in queries.piecewise_fingerprints(spark, str(TESTDATA)).collect()}
    assert set(got) == {k for k, _ in texts}
    own = {k: plain_fingerprint(t or "") for k, t in texts}
    for (key, text), (after, following) in zip(texts, texts[1:] + texts[:1]):
        text, following = text or "", following or ""
        changed = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
        print_, r = plain_fingerprint(changed), got[key]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own[key], print_)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert math.isclose(r.near_edited, plain_likeness(own[key], print_), abs_tol=1e-12)
        assert math.isclose(r.near_next, plain_likeness(own[key], own[after]), abs_tol=1e-12)
    for text in NASTY:
        if len(text) < 10_000:
            assert piecewise.fingerprint(text) == plain_fingerprint(text)


# masked pseudo-likelihood

def test_counts_and_scores(spark, edge_docs, no_docs):
    counted = Counter({(r.context << 5 | r.own): r.n for r in masked_lm.count_windows(edge_docs).collect()})
    wanted = Counter()
    for _, text in pairs(edge_docs):
        classes = [masked_lm.BORDER] * 2 + masked_lm.classes_of(text).tolist() + [masked_lm.BORDER] * 2
        for i in range(2, len(classes) - 2):
            a, b, own, c, d = classes[i - 2:i + 3]
            wanted[(((a << 5 | b) << 5 | c) << 5 | d) << 5 | own] += 1
    assert counted == wanted
    weights = masked_lm.train(masked_lm.count_windows(edge_docs))
    network = masked_lm.Network(weights)
    for r in masked_lm.score(edge_docs.where("doc_id = 7"), weights).collect():
        codes = masked_lm.windows_of(masked_lm.classes_of(NASTY[7]))
        exact = network.log_probabilities(codes >> 5)[np.arange(len(codes)), codes & 31].sum()
        assert r.n_tokens == len(NASTY[7]) and abs(r.log_likelihood - exact) < len(codes) / masked_lm.STEPS
    assert masked_lm.score(edge_docs, weights).count() == edge_docs.count()
    assert masked_lm.score_by_own_corpus(no_docs).count() == 0


def test_training_helps_on_held_out_text(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    fitted, held_out = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    before, after = masked_lm.Network().weights, masked_lm.train(masked_lm.count_windows(fitted))
    mean = lambda w: masked_lm.score(held_out, w).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(after) > -2.3 > mean(before)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    contexts, counts = rng.integers(0, 1 << 20, 40), rng.integers(0, 4, (40, 32)).astype(float)
    network = masked_lm.Network()
    loss = lambda w: -(masked_lm.Network(w).log_probabilities(contexts) * counts).sum() / counts.sum()
    slope, w = network.gradient(contexts, counts), network.weights
    for i in rng.integers(0, len(w), 12):
        step = np.zeros_like(w)
        step[i] = 1e-5
        assert abs((loss(w + step) - loss(w - step)) / 2e-5 - slope[i]) < 1e-6


# line dedup

def _bare(line):
    return re.sub(r"[\x09-\x0D]", " ", line).strip(" ")


def test_boilerplate_lines(spark, edge_docs, no_docs):
    rows = []
    for i in range(60):
        lines = [f"own line number {i} stays", "a footer that is on every site", "two words", "", "shared by three sites" if i % 20 < 3 else "x",
                 "exactly four sites have it" if i % 20 < 4 else f"and another own one {i}"]
        rows.append((i, "\n".join(lines), f"site{i % 20}", "c"))
    rows += [(60, None, None, "c"), (61, "", "site1", "c"), (5, rows[5][1], "site5", "c"),
             (None, "a footer that is on every site\n a footer that is on every site\t", "site3", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line string").repartition(4)
    sites = defaultdict(set)
    first = {}
    for key, text, source, _ in rows:
        for no, line in enumerate((text or "").split("\n")):
            bare = _bare(line)
            if len(bare.split()) >= 3:
                sites[bare].add(source)
                place = (key is not None, key or 0, no)
                first[bare] = min(first.get(bare, place), place)
    wanted = Counter()
    for key, text, source, _ in rows:
        kept = [line for no, line in enumerate((text or "").split("\n")) if not (
            len(sites[_bare(line)] - {None}) >= 4 and first[_bare(line)] != (key is not None, key or 0, no))]
        wanted[key, None if text is None else "\n".join(kept)] += 1
    found = Counter((r.doc_id, r.text) for r in line_spread.without_boilerplate(docs).collect())
    assert found == wanted
    assert line_spread.without_boilerplate(docs).columns == docs.columns
    assert line_spread.without_boilerplate(edge_docs).count() == edge_docs.count()
    assert line_spread.remove_boilerplate(no_docs).count() == 0


# quality rules

def _quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            failed)


def test_quality_measures(spark, edge_docs, no_docs):
    extra = ["a b c d e f g h i j a b c d e f g h z " * 2, "one two three four five six seven eight " * 9, "x y " * 9,
             "the cat and the dog " * 2 + " ".join(f"w{i}" for i in range(40)), "### $$$ | | the and of " * 10]
    docs = edge_docs.select("doc_id", "text", "row").unionByName(
        spark.createDataFrame([(200 + i, t, "r") for i, t in enumerate(extra)], "doc_id long, text string, row string"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality.judged(docs).select("row.doc_id", "row.text", *[f"quality.{n}" for n in names], "base_failed", "kept").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(pairs(docs))
    for r in rows:
        assert tuple(r)[2:8] == _quality(r.text), repr(r.text)[:60]
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} >= {203} and 204 not in {r.doc_id for r in rows if r.kept}
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judged(no_docs).count() == 0


# SimHash

def _roots(prints):
    distinct = np.unique(np.array(prints, np.uint64))
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1:] ^ distinct[i]) <= simhash.THRESHOLD) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(p): int(distinct[find(i)]) for i, p in enumerate(distinct)}


def _grouped(roots):
    groups = defaultdict(set)
    for node, root in roots.items():
        groups[root].add(node)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("most", [20_000, 40])
def test_no_link_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", most)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:50].tolist():
        at = b
        for _ in range(6):  # chains of at most four flips each
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                at ^= 1 << bit
            prints.add(at)
    hub = int(base[0])
    prints |= {hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    frame = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long")
    rows = simhash.components(simhash.links(frame.repartition(4))).collect()
    found = {p: p for p in prints} | {r.node % 2**64: r.root % 2**64 for r in rows}
    assert _grouped(found) == _grouped(_roots(list(prints)))


def test_near_duplicates(spark, edge_docs, no_docs):
    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = edge_docs.where(F.length("text").isNull() | (F.length("text") < 60_000))
    texts = pairs(docs)
    roots = _roots([plain(t) for _, t in texts])
    least = {}
    for key, text in texts:
        root = roots[plain(text)]
        least[root] = min((k for k in (least.get(root), key) if k is not None), default=None)
    wanted = Counter((k, f"{plain(t):016x}", least[roots[plain(t)]]) for k, t in texts)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == wanted
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(roots[plain(r.text)] for r in kept.collect()) == sorted(set(roots.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("unit", ["7", "#", "x", "漢", "7 ", ". "])
def test_quality_of_very_long_words_is_linear(spark, unit):
    """Ten megabytes of digits, marks or letters, as one word or as many, take seconds."""
    import time
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(unit), 10_000_000 // len(unit.encode())).alias("text"))
    start = time.perf_counter()
    row = quality.judged(docs).select("quality.n_alpha_words", "quality.n_words").first()
    assert time.perf_counter() - start < 60
    assert row["n_alpha_words"] == (row["n_words"] if unit in "x漢" else 0)

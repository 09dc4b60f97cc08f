"""Ranked lexical search by pipelined term partitioning.

Documents are dealt into shards of some thousand as they are scanned, and each shard is inverted in the scanning task: a
row for each of its terms with the places of its documents and the counts there. Terms have owners by how rare they are.
Items travel in bundles: a row for each shard and bundle with sparse accumulators (item, document, score) goes through
the owners' stages one after another, meets the owner's postings of the shard by cogroup, and adds whole-number
contributions. Rare terms come first, and an accumulator is dropped once even the most that the later owners can add
leaves it below the 20th best of its shard; such a document cannot be among the best of all, so the result is exact.
After the last stage the best of each shard are ranked.

Scores. With N the documents that have a term, L their terms, n a document's terms, df and tf as usual: a term weighs
``floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 75 + 25 n N div L``, and an occurrence in the item adds
``weight * (1000000000 tf div (1000 tf + 12 m))``.

Items are read in blocks of a bounded number of terms; a block is one pass over the documents. What a task holds is
bounded by a shard's documents and a bundle's items; no document or term is a hot key, as each has one row in a shard.

Nulls: a null text has no terms, so its document is never found and its item finds nothing; null keys are kept, and a
null document key comes last among equal scores. Rows of the items table are items of their own, even where they repeat;
repeated documents are found as often as they occur. Empty tables give an empty result. Other columns are left out.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

#: Bytes of terms are letters, digits and all of other scripts; only A to Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRETCH = 1 << 20

SHARD_DOCS = 2048
BUNDLE_ITEMS = 128
#: Terms (with repeats) of the items in one block, at most, unless one item alone has more.
BLOCK_TERMS = 200_000
#: Owners by the share of documents that hold a term: below 1/256, 1/32, 1/4, the rest.
OWNERS = (256, 32, 4)
#: No occurrence adds more than this times its weight.
MOST = 1_000_000


def terms(text: str | None) -> Iterator[bytes]:
    """All terms of a whole text, cut in stretches at a gap so that a very long text is not listed at once."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield from data[at:end].split()
        at = end


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    block, held = [], 0
    for row in items.select(F.col(f"`{key}`"), F.col(f"`{text}`")).toLocalIterator():
        found = Counter(terms(row[1]))
        if block and held + found.total() > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((row[0], found))
        held += found.total()
    if block:
        yield block


def _packed(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def _invert(docs: DataFrame, known: dict[bytes, int], path: str) -> None:
    """Write a row for each shard (term null: documents' keys and lengths) and for each term in it (places, counts)."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, part, number = held.value, TaskContext.get().partitionId(), 0
        keys, missing, lengths, postings = [], [], [], {}

        def shard() -> pd.DataFrame:
            rows = [(None, len(keys), sum(lengths), _packed(keys, "<i8"), _packed(lengths, "<i8"), _packed(missing, "u1"))]
            rows += [(t, len(p), 0, _packed([x for x, _ in p], "<u2"), _packed([x for _, x in p], "<u4"), b"")
                     for t, p in postings.items()]
            out = pd.DataFrame(rows, columns=["term", "docs", "total", "places", "counts", "missing"])
            return out.assign(term=out["term"].astype("Int32"), shard=part << 32 | number)[
                ["shard", "term", "docs", "total", "places", "counts", "missing"]]

        for batch in batches:
            for key, absent, text in zip(batch["key"].tolist(), batch["absent"].tolist(), batch["text"].tolist()):
                n, here = 0, Counter()
                for term in terms(text):
                    n += 1
                    if term in vocabulary:
                        here[vocabulary[term]] += 1
                if not n:
                    continue
                for term, count in here.items():
                    postings.setdefault(term, []).append((len(keys), count))
                keys.append(key), missing.append(absent), lengths.append(n)
                if len(keys) == SHARD_DOCS:
                    yield shard()
                    keys, missing, lengths, postings, number = [], [], [], {}, number + 1
        if keys:
            yield shard()

    docs.mapInPandas(run, "shard long, term int, docs long, total long, places binary, counts binary, missing binary"
                     ).write.parquet(path)


def search(docs: DataFrame, items: DataFrame, top: int = 20, text: str = "text", key: str = "doc_id",
           item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item key, ``rank`` from 1, document key and ``score``; equal
    scores by ascending key. Documents without a common term are not ranked."""
    spark = docs.sparkSession
    kind = {n: t for n, t in items.dtypes}[item_key]
    narrow = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("key"),
                         F.col(f"`{key}`").isNull().alias("absent"), F.col(f"`{text}`").alias("text"))
    found, base, names = None, 0, []
    for block in _blocks(items, item_key, item_text):
        part = _search_block(narrow, [terms_ for _, terms_ in block], base, top)
        found = part if found is None else found.unionByName(part)
        names += [(base + i, name) for i, (name, _) in enumerate(block)]
        base += len(block)
    if found is None:
        return spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` long, score long")
    named = spark.createDataFrame(names, f"no long, `{item_key}` {kind}")
    best = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(named, "no").select(f"`{item_key}`", "rank", F.col("key").alias(key), "score")


def _search_block(docs: DataFrame, block: list[Counter], base: int, top: int) -> DataFrame:
    """The best ``top`` documents of each shard for the items of a block, numbered from ``base``."""
    spark = docs.sparkSession
    known = {term: i for i, term in enumerate(sorted(set().union(*block)))}
    path = shared_dir(spark, "postings")
    _invert(docs, known, path)
    index = spark.read.parquet(path)
    # a row for each term of the block, and one for the documents
    counts = {r["term"]: (r["docs"], r["total"]) for r in index.groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("total").alias("total")).collect()}
    n, length = counts.pop(None, (0, 0))
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, (df, _) in counts.items()}
    owners = {t: sum(df * share >= n for share in OWNERS) for t, (df, _) in counts.items()}

    bundles = [block[i:i + BUNDLE_ITEMS] for i in range(0, len(block), BUNDLE_ITEMS)]
    #: For each bundle: who asks for a term, how often; and the most that owners from a stage on can add to an item.
    asked: list[dict[int, list[tuple[int, int]]]] = []
    most = []
    for bundle in bundles:
        of, bound = {}, np.zeros((len(OWNERS) + 2, len(bundle)), np.int64)
        for i, item in enumerate(bundle):
            for term, times in item.items():
                if known[term] in weights:
                    of.setdefault(known[term], []).append((i, times))
                    bound[owners[known[term]], i] += weights[known[term]] * times * MOST
        asked.append(of)
        most.append(bound[::-1].cumsum(axis=0)[::-1])
    plan = spark.sparkContext.broadcast((weights, asked, most))
    wanted = F.broadcast(spark.createDataFrame(  # at most BLOCK_TERMS rows
        [(t, owners[t], b) for b, of in enumerate(asked) for t in of], "term int, owner int, bundle int"))
    postings = spark.read.parquet(path).where("term is not null").join(wanted, "term").select(
        "shard", "bundle", "owner", "term", "places", "counts")
    state = "shard long, bundle int, keys binary, missing binary, lengths binary, items binary, at binary, scores binary"
    empty = F.lit(b"")
    travelling = index.where("term is null").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(len(bundles) - 1))).alias("bundle"), F.col("places").alias("keys"),
        "missing", F.col("counts").alias("lengths"), empty.alias("items"), empty.alias("at"), empty.alias("scores"))

    def stage(owner: int):
        def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            weight, askers, bounds = plan.value
            if left.empty:
                return left
            row = left.iloc[0]
            of, rest = askers[row["bundle"]], bounds[row["bundle"]][owner + 1]
            lengths = np.frombuffer(row["lengths"], "<i8")
            m = 75 + 25 * lengths * n // length
            totals = np.zeros((len(rest), len(lengths)), np.int64)
            totals[np.frombuffer(row["items"], "<u2"), np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["scores"], "<i8")
            for term, places, counts in zip(right["term"].tolist(), right["places"], right["counts"]):
                at, tf = np.frombuffer(places, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
                for item, times in of[term]:
                    totals[item, at] += gain * times
            if totals.shape[1] > top:
                least = np.partition(totals, -top, axis=1)[:, -top]
                totals[totals + rest[:, None] < least[:, None]] = 0
            item, at = np.nonzero(totals)
            return left.assign(items=[_packed(item, "<u2")], at=[_packed(at, "<u2")], scores=[_packed(totals[item, at], "<i8")])
        return add

    for owner in range(len(OWNERS) + 1):
        mine = postings.where(F.col("owner") == owner).drop("owner")
        travelling = (travelling.groupBy("shard", "bundle").cogroup(mine.groupBy("shard", "bundle"))
                      .applyInPandas(stage(owner), state))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, keys, missing, items, at, scores in zip(*(
                    batch[c].tolist() for c in ("bundle", "keys", "missing", "items", "at", "scores"))):
                at = np.frombuffer(at, "<u2")
                key = pd.Series(np.frombuffer(keys, "<i8")[at], dtype="Int64")
                key[np.frombuffer(missing, "u1")[at] == 1] = pd.NA
                out = pd.DataFrame({"no": base + bundle * BUNDLE_ITEMS + np.frombuffer(items, "<u2").astype(np.int64),
                                    "key": key, "score": np.frombuffer(scores, "<i8")})
                yield out.sort_values(["no", "score", "key"], ascending=[True, False, True]).groupby("no").head(top)

    return travelling.mapInPandas(unpack, "no long, key long, score long")

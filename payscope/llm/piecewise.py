"""Context-triggered piecewise hashing: fingerprints of whole texts that survive edits, and their likeness.

A rolling hash over seven bytes ends a piece wherever it leaves the greatest remainder to the block size. Block sizes are
3, 6, 12, ...; the block size of a text is the smallest that gives at most 64 pieces. A fingerprint is
``block:signature:signature at twice the block``, one character for the hash of each piece. Signatures of equal block
size are compared by edit distance; with block sizes that differ by a factor of two, those of the same size.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .histogram import Cut, place, sortable, splitters

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK = 3
PIECES = 64
ROLL = 7
WIDTH = 16
#: Bytes hashed at once, and bytes of text in one range of neighbours.
STRETCH = 1 << 20
RANGE_BYTES = 32 << 20
RANGES = 512


def _levels(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, and the highest doubling of the least block at which it does."""
    places, levels = [], []
    for at in range(0, len(data), STRETCH):
        lead = min(at, ROLL - 1)
        part = np.frombuffer(data, np.uint8, min(STRETCH, len(data) - at) + lead, at - lead).astype(np.uint32)
        rolled = part.copy()
        factor = 1
        for back in range(1, ROLL):
            factor = factor * 0x01000193 & 0xFFFFFFFF
            rolled[back:] += part[:-back] * np.uint32(factor)
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x85EBCA6B)
        rolled ^= rolled >> np.uint32(13)
        value = rolled[lead:].astype(np.int64) + 1
        hit = np.flatnonzero(value % LEAST_BLOCK == 0)
        quotient = value[hit] // LEAST_BLOCK
        places.append(hit + at)
        levels.append(np.log2(quotient & -quotient).astype(np.int64))
    return (np.concatenate(places), np.concatenate(levels)) if places else (np.empty(0, np.int64),) * 2


def _signature(data: bytes, ends: np.ndarray) -> str:
    start, found = 0, []
    for end in (ends + 1).tolist():
        found.append(ALPHABET[zlib.crc32(data[start:end]) >> 5 & 63])
        start = end
    if start < len(data):
        found.append(ALPHABET[zlib.crc32(data[start:]) >> 5 & 63])
    return "".join(found)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; a null text is empty, and an empty text has no pieces."""
    data = ("" if text is None else text).encode("utf-8", "surrogatepass")
    places, levels = _levels(data)
    at_least = np.cumsum(np.bincount(levels, minlength=1)[::-1])[::-1]
    level = int(np.argmax(np.r_[at_least, 0] <= PIECES))
    first, second = (_signature(data, places[levels >= level + k]) for k in (0, 1))
    return f"{LEAST_BLOCK << level}:{first}:{second}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance by the longer signature, at the block size both have; 0 if they share none."""
    x, y = F.split(a, ":"), F.split(b, ":")
    part = lambda v, k: F.get(v, k)
    p, q = part(x, 0).cast("long"), part(y, 0).cast("long")

    def alike(s: Column, t: Column) -> Column:
        longest = F.greatest(F.length(s), F.length(t))
        return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(s, t) / longest)

    return (F.when(p == q, F.greatest(alike(part(x, 1), part(y, 1)), F.when(
                (F.length(part(x, 2)) > 1) & (F.length(part(y, 2)) > 1), alike(part(x, 2), part(y, 2))).otherwise(0.0)))
            .when(p == q * 2, alike(part(x, 1), part(y, 2))).when(p * 2 == q, alike(part(x, 2), part(y, 1)))
            .otherwise(0.0).cast("double"))


def with_next(docs: DataFrame, made: Callable[[list[str], list[str]], pd.DataFrame], schema: str, text: str = "text",
              key: str = "doc_id") -> DataFrame:
    """``key`` and what ``made(texts, next texts)`` gives for each document and the next one by ascending key.

    The document after the last is the first. Equal keys are ordered by text hash, null keys come first, null texts are
    empty. Documents are exchanged once, in ranges of neighbours of about equal bytes that a histogram of the keys finds.
    The first key of a range is known from it, so its rows go to the range before as well, as what comes after it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), body.alias("text"),
                       sortable(F.col(f"`{key}`").cast("long"), F.xxhash64(body)).alias("key"))
    sizes = rows.select("key", (F.octet_length("text") + 8).cast("long").alias("size"))
    rough = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.min("key")).first()
    ranges = int(max(1, min(rough[0] // 4, max(RANGES, -(-rough[1] // RANGE_BYTES)))))
    width = rough[1] / ranges
    found, _, _ = splitters(sizes, [width * k for k in range(1, ranges)], [width / 2] * (ranges - 1), WIDTH)
    low = int.from_bytes(bytes(rough[2]), "big") if rough[0] else 0
    cuts = sorted({c.key: c for c in found if c.key > low and c.rows < rough[0]}.values(), key=lambda c: c.key)
    return _neighbours(rows, [Cut(low, 0, 0), *cuts], made, schema, key)


def _neighbours(rows: DataFrame, cuts: list[Cut], made, schema: str, key: str) -> DataFrame:
    n = len(cuts)
    ranged = rows.withColumn("range", place(F.col("key"), cuts, WIDTH) - 1)
    #: The first key of each range: the least key at or above its cut.
    heads = {r["range"]: bytes(r["head"]) for r in ranged.groupBy("range").agg(F.min("key").alias("head")).collect()}
    order = sorted(heads)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}
    packed = np.array(sorted(before) or [b""], f"S{WIDTH}")
    ahead = np.array([before[h] for h in sorted(before)] or [0], np.int64)

    @F.pandas_udf("int")
    def leads(keys: pd.Series) -> pd.Series:
        own = np.array(keys.tolist(), packed.dtype)
        at = np.minimum(np.searchsorted(packed, own), len(packed) - 1)
        return pd.Series(np.where(packed[at] == own, ahead[at], -1).astype(np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            place_, follows = frame["to"].to_numpy(), frame["follows"].to_numpy(bool)
            same = place_[:-1] == place_[1:]
            use = np.flatnonzero(same & ~follows[:-1])
            for at in range(0, len(use), 500):
                own = use[at:at + 500]
                texts = frame["text"].to_numpy(object)
                out = made(list(texts[own]), list(texts[own + 1]))
                out.insert(0, key, frame["doc"].astype("Int64").to_numpy()[own])
                yield out
            held = frame.iloc[-1:]

    # a head goes to the range before it too; the one copy needed there is the first after all rows of that range
    sent = ranged.withColumn("lead", leads("key")).select(
        "doc", "text", "key", F.explode(F.when(F.col("lead") >= 0, F.array(
            F.struct(F.col("range").alias("to"), F.lit(False).alias("follows")),
            F.struct(F.col("lead").alias("to"), F.lit(True).alias("follows")))).otherwise(
                F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("follows"))))).alias("x"))
    sent = sent.select("doc", "text", "key", "x.*")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sent.repartition(max(parts, -(-n // 16)), "to").sortWithinPartitions("to", "follows", "key")
            .mapInPandas(run, f"`{key}` long, {schema}"))


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first characters of the following one."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def _row(texts: list[str], following: list[str]) -> pd.DataFrame:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    prints, known = [fingerprint(t) for t in texts], {}
    for t, p in zip(texts, prints):
        known[t] = p
    return pd.DataFrame({
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": prints, "edited_fingerprint": [fingerprint(t) for t in changed],
        "next_fingerprint": [known.get(t) or fingerprint(t) for t in following]})


def compared_with_edit_and_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, with their likeness to the first.

    See :func:`with_next` for order, nulls, ties and repeated rows. A table of one row is followed by itself.
    """
    shape = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    return (with_next(docs, _row, shape, text, key)
            .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
            .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))))

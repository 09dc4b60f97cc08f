"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most four bits differ in at most one bit within one of three blocks of 21, 21
and 22 bits. In a block, 15 bits are covered by the perfect Hamming code of that length (covering radius 1), the other
bits by themselves (radius 0): every block value has one nearest anchor, its home. A fingerprint is replicated to every
anchor within covering radius plus threshold of each block, so the home of one fingerprint of a linked pair is always
among the anchors of the other, and comparing per anchor loses no link.

Only distinct fingerprints are compared. What is said about them is a forest: of the links found in a chunk of anchors
only those are kept that join something. Components come from these edges by joins alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: First bit and length of each block; a block's low 15 bits are coded.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15
#: Rows of one anchor compared by one task. Larger anchors are cut into parts of this size, and pairs of parts compared.
ANCHOR_ROWS = 20_000
#: Rows held while anchors are compared, and pairs compared at once.
CHUNK_ROWS = 200_000
PAIRS = 2_000_000


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text: a bit is set where over half the shingle hashes have it set."""
    from xxhash import xxh64_intdigest

    words = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-SHINGLE].tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` (as a long), ``digest`` (a hash of key and text) and ``fingerprint`` (64 bits as a long) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, batch["text"]), np.uint64, len(batch)).view(np.int64)
            yield pd.DataFrame({"key": batch["key"].astype("Int64"), "digest": batch["digest"], "fingerprint": found})

    narrow = _keyed(docs, text, key).select("key", "digest", "text")
    return narrow.mapInPandas(run, "key long, digest long, fingerprint long")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    row = docs.select(F.struct("*").alias("row"))
    named = row.select("row", F.col(f"row.`{key}`").cast("long").alias("key"), F.col(f"row.`{text}`").alias("text"))
    return named.withColumn("digest", F.xxhash64(F.coalesce("key", F.lit(0)), F.coalesce("text", F.lit(""))))


def _syndromes() -> np.ndarray:
    values = np.arange(1 << CODED, dtype=np.uint32)
    found = np.zeros(1 << CODED, np.uint32)
    for bit in range(CODED):
        found ^= np.where(values >> bit & 1, bit + 1, 0).astype(np.uint32)
    return found


def _anchors_within_two() -> np.ndarray:
    """For each value of the coded bits its anchors within distance two, home first, filled up with -1."""
    values, syndrome = np.arange(1 << CODED, dtype=np.int32), _syndromes().astype(np.int32)
    flip = lambda s: np.where(s > 0, 1 << np.maximum(s - 1, 0), 0).astype(np.int32)
    home = values ^ flip(syndrome)
    columns = [home]
    for bit in range(CODED):  # flip one bit, then the bit that leads back into the code; each pair of bits once
        second = syndrome ^ (bit + 1)
        use = (syndrome > 0) & (second > bit + 1)
        columns.append(np.where(use, values ^ (1 << bit) ^ flip(second), -1).astype(np.int32))
    return np.stack(columns, axis=1)


def replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor id, index into ``prints`` and whether it is the home, for every anchor near each fingerprint."""
    near = _anchors_within_two()
    anchors, owners, homes = [], [], []
    index = np.arange(len(prints))
    for block, (first, length) in enumerate(BLOCKS):
        value = (prints >> np.uint64(first)) & np.uint64((1 << length) - 1)
        coded = (value & np.uint64((1 << CODED) - 1)).astype(np.int64)
        rest = (value >> np.uint64(CODED)).astype(np.int64)
        base = block << 24
        found = near[coded]
        for k in range(found.shape[1]):
            use = found[:, k] >= 0
            anchors.append(base | rest[use] << CODED | found[use, k])
            owners.append(index[use])
            homes.append(np.full(use.sum(), k == 0))
        for bit in range(length - CODED):
            anchors.append(base | (rest ^ 1 << bit) << CODED | found[:, 0])
            owners.append(index)
            homes.append(np.zeros(len(prints), bool))
    return np.concatenate(anchors).astype(np.int32), np.concatenate(owners), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each end of the given links to the smallest end it can reach through them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(group: np.ndarray, prints: np.ndarray, home: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between home rows and all rows of their group, rows being sorted by group.

    ``part`` is -1 for a whole anchor. In a pair of parts it is the row's part (0 or 1), and rows of different parts
    are compared; the pair of a part with itself is a whole anchor.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    which = np.repeat(np.arange(len(starts)), ends - starts)
    asking = np.flatnonzero(home)
    counts = ends[which[asking]] - starts[which[asking]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    steps = np.cumsum(counts)
    at = 0
    while at < len(asking):
        stop = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + PAIRS, side="right")))
        rows, many = asking[at:stop], counts[at:stop]
        left = np.repeat(rows, many)
        right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[which[rows]], many)
        x, y = prints[left], prints[right]
        near = (np.bitwise_count(x ^ y) <= THRESHOLD) & (x != y) & ((part[left] < 0) | (part[left] != part[right]))
        if near.any():
            found.append(forest(x[near], y[near]))
        if len(found) > 20:
            found = [forest(*map(np.concatenate, zip(*found)))]
        at = stop
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(*map(np.concatenate, zip(*found)))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor and cell; whole groups are gathered up to CHUNK_ROWS and compared."""
    held: list[pd.DataFrame] = []

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        cell = rows["cell"].to_numpy(np.int64)
        group = np.cumsum(np.r_[True, (np.diff(rows["anchor"].to_numpy(np.int64)) != 0) | (np.diff(cell) != 0)])
        a, b = _links(group, rows["fingerprint"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool),
                      rows["part"].to_numpy(np.int64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < CHUNK_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        same = (rows["anchor"] == rows["anchor"].iloc[-1]) & (rows["cell"] == rows["cell"].iloc[-1])
        if same.all():
            held = [rows]
            continue
        yield compared(rows[~same])
        held = [rows[same]]
    if held and sum(map(len, held)):
        yield compared(pd.concat(held, ignore_index=True))


def links(prints: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that join all fingerprints linked through others. ``prints``: distinct ``fingerprint``.

    An anchor with more than ANCHOR_ROWS replicas is cut into p parts by fingerprint hash; each row goes to the p pairs
    of parts it belongs to, so the anchor's comparisons are spread over p * (p + 1) / 2 groups and none is left out.
    """
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = batch["fingerprint"].to_numpy(np.int64)
            for at in range(0, len(bits), 20_000):
                own = bits[at:at + 20_000]
                anchor, owner, home = replicas(own.view(np.uint64))
                yield pd.DataFrame({"anchor": anchor, "fingerprint": own[owner], "home": home})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = batch["parts"].to_numpy(np.int64)
            whole = batch[parts <= 1][["anchor", "fingerprint", "home"]]
            yield whole.assign(cell=0, part=-1)
            for n in np.unique(parts[parts > 1]):
                rows = batch[parts == n]
                mixed = rows["fingerprint"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                own = ((mixed >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
                for other in range(n):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    yield pd.DataFrame({"anchor": rows["anchor"].to_numpy(), "fingerprint": rows["fingerprint"].to_numpy(),
                                        "home": rows["home"].to_numpy(), "cell": low * n + high,
                                        "part": np.where(own == other, -1, (own > other).astype(np.int64))})

    placed = prints.mapInPandas(spread, "anchor int, fingerprint long, home boolean")
    hot = (placed.groupBy("anchor").count().where(F.col("count") > ANCHOR_ROWS)
           .select("anchor", F.ceil(F.col("count") / ANCHOR_ROWS).cast("int").alias("parts")))
    shape = "anchor int, fingerprint long, home boolean, cell long, part long"
    marked = placed.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return (marked.mapInPandas(cells, shape).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
            .mapInPandas(_compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it reaches) for every end of an edge (``a``, ``b``).

    Alternating large-star and small-star steps; each step is written to the shared folder, which cuts the lineage, and
    pre-aggregates per node, so that no neighbourhood is gathered. A step that leaves the edges as they were is the last.
    """
    spark = edges.sparkSession

    def stored(rows: DataFrame) -> DataFrame:
        path = shared_dir(spark, "components")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    def star(rows: DataFrame, small: bool) -> DataFrame:
        both = rows if small else rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wired = both.join(least, "a")
        if small:  # neighbours that are smaller, and the node itself, hang on the smallest
            return (wired.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
                    .where("a <> b").distinct())
        return wired.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def stamp(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = stored(ordered(edges))
    before = stamp(current)
    while before[0]:
        current = stored(star(ordered(star(current, small=False)), small=True))
        after = stamp(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``digest``, ``fingerprint``, ``root`` (a fingerprint that names the component) and ``component_id``."""
    spark = docs.sparkSession

    def stored(rows: DataFrame, name: str) -> DataFrame:
        path = shared_dir(spark, name)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    rows = stored(fingerprints(docs, text, key), "fingerprints")
    names = stored(rows.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct-fingerprints")
    roots = components(links(names.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    of = names.join(roots, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, one row for each row of ``docs``.

    ``component_id`` is the smallest key that can be reached over links of four bits or fewer, the row's own included.
    Null texts, empty texts and texts of white space have fingerprint zero and are linked like any other. Rows without a
    key belong to components but give them no name; a component without any key has a null name. Rows with equal text
    have equal fingerprints, and repeated rows stay. Columns other than the two named are not read.
    """
    return grouped(docs, text, key).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, with the table's columns: the one with the smallest key (null last), and among rows
    with that key the one with the smallest hash. Of fully repeated rows one stays."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", "digest")
    best = grouped(docs, text, key).groupBy("root").agg(F.min(order).alias("best"))
    best = best.select(F.col("best.key").alias("kept_key"), F.col("best.digest").alias("kept_digest")).distinct()
    rows = _keyed(docs, text, key).join(best, (F.col("digest") == F.col("kept_digest"))
                                        & F.col("key").eqNullSafe(F.col("kept_key")))
    return rows.groupBy("digest", "key").agg(F.first("row").alias("row")).select("row.*")

"""Byte-level BPE over the distinct words of the whole corpus, and decoding by the token-byte table.

Documents are taken in chunks. A chunk explodes its texts into pre-tokens and keeps, for every document, the positions as
indices into the chunk's distinct words. The distinct words of all chunks are shuffled by hash, so each distinct word of
the corpus meets in one place and is encoded once; its ids go back to the chunks that asked, and the documents are put
together again by position. A word takes part once for each chunk, however often it occurs, so frequent words weigh no
more than rare ones.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

from .words import INNER_SPACE, space_led_words

#: Characters of a chunk, about (one longer document is a chunk of its own), and bytes of text for each word bucket.
CHUNK_CHARS = 15_000_000
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
MOST_BUCKETS = 1 << 16
LEVEL = 9


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _packed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(array.tobytes(), LEVEL)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), dtype)


def pack_strings(items: list[bytes]) -> bytes:
    import zstandard

    return zstandard.compress(b"".join([np.array([len(items), *map(len, items)], "<u4").tobytes(), *items]), LEVEL)


def unpack_strings(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def to_varints(values: np.ndarray) -> bytes:
    """Seven bits to a byte, low first; the high bit says that more follow."""
    sizes = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    out = np.zeros(int(sizes.sum()), np.uint8)
    first = np.cumsum(sizes) - sizes
    for k in range(5):
        use = sizes > k
        out[first[use] + k] = (values[use] >> (7 * k) & 127) | np.where(sizes[use] > k + 1, 128, 0)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(5):
        use = starts + k <= ends
        values[use] |= (raw[starts[use] + k].astype(np.int64) & 127) << (7 * k)
    return values


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


class _Chunk:
    """Distinct words of some documents, and each document as indices into them."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.led: dict[str, bytes] = {}

    def _exploded(self, text: str) -> bytes:
        known = self.words
        return np.array([known.setdefault(word, len(known)) for word in self.find(text)], "<u4").tobytes()

    def positions(self, text: str) -> bytes:
        if INNER_SPACE.search(text):
            return self._exploded(text)
        parts, led = space_led_words(text), self.led
        for part in parts:
            if part not in led:
                led[part] = self._exploded(part)
        return b"".join(map(led.__getitem__, parts))

    def packed(self, texts: list[str]) -> dict:
        """Words in order of frequency class and, in a class, of their bytes: the classes are those of varint sizes."""
        found = [self.positions(text) for text in texts]
        flat = np.frombuffer(b"".join(found), "<u4")
        words = np.array([w.encode("utf-8", "surrogatepass") for w in self.words] + [b""], object)[:-1]
        seldom = np.empty(len(words), np.int64)
        seldom[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words))
        size = (seldom >= 1 << 7).astype(np.int64) + (seldom >= 1 << 14) + (seldom >= 1 << 21)
        order = sorted(range(len(words)), key=lambda i: (size[i], words[i]))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        import zstandard

        return {"words": pack_strings(words[order].tolist()), "positions": zstandard.compress(to_varints(place[flat]), LEVEL),
                "counts": [len(f) // 4 for f in found]}


def stage_chunks(docs: DataFrame, pattern: str, text: str, key: str) -> DataFrame:
    """Chunks, written once: ``chunk``, ``docs``, ``counts`` (pre-tokens of each), ``positions``, ``words``, ``bytes``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            keys = [None if pd.isna(k) else int(k) for k in batch["doc"]]
            start = chars = 0
            for i, own in enumerate(texts):
                chars += len(own)
                if chars >= CHUNK_CHARS or i + 1 == len(texts):
                    made = _Chunk(pattern).packed(texts[start:i + 1])
                    yield pd.DataFrame([{"chunk": part << 32 | number, "docs": keys[start:i + 1], **made,
                                         "bytes": sum(len(t) for t in texts[start:i + 1])}])
                    number, start, chars = number + 1, i + 1, 0

    path = shared_dir(docs.sparkSession, "word-chunks")
    (docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
     .mapInPandas(run, "chunk long, docs array<long>, words binary, positions binary, counts array<int>, bytes long")
     .write.option("compression", "uncompressed").parquet(path))
    return docs.sparkSession.read.parquet(path)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` (keys) of each chunk with their ids: rows of ``docs`` array, ``counts`` array (ids of each), ``ids`` binary
    (little-endian, ``wide`` bytes each). :func:`per_document` opens them.

    A null text is empty and has no ids; keys may be null or repeat; every row is kept; other columns are not read. Words
    are whole matches of the pattern; each is encoded by the ranks without special tokens.
    """
    staged = stage_chunks(docs, pattern, text, key)
    size = staged.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = int(min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, words in zip(batch["chunk"].tolist(), batch["words"]):
                split: list[list[bytes]] = [[] for _ in range(buckets)]
                for word in unpack_strings(words):
                    split[bucket_of(word, buckets)].append(word)
                own = [b for b in range(buckets) if split[b]]
                yield pd.DataFrame({"bucket": own, "chunk": chunk, "words": [pack_strings(split[b]) for b in own]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = load_ranks(ranks)
        book = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={})
        dtype = np.dtype("<u2" if max(table.values(), default=0) < 1 << 16 else "<u4")
        bucket, known = None, {}
        for batch in batches:
            for b, chunk, words in zip(batch["bucket"].tolist(), batch["chunk"].tolist(), batch["words"]):
                if b != bucket:
                    bucket, known = b, {}
                found = []
                for word in unpack_strings(words):
                    ids = known.get(word)
                    if ids is None:  # the first chunk that has the word
                        ids = known[word] = np.array(book.encode_ordinary(word.decode("utf-8", "surrogatepass")),
                                                     dtype).tobytes()
                    found.append(ids)
                yield pd.DataFrame([{"chunk": chunk, "bucket": b, "wide": dtype.itemsize, "ids": pack_strings(found)}])

    asked = staged.select("chunk", "words").mapInPandas(ask, "bucket int, chunk long, words binary")
    answers = (asked.repartition("bucket").sortWithinPartitions("bucket", "chunk")
               .mapInPandas(answer, "chunk long, bucket int, wide int, ids binary")
               .groupBy("chunk").agg(F.max("wide").alias("wide"), F.collect_list(F.struct("bucket", "ids")).alias("answers")))
    whose = staged.select("chunk", "words").mapInPandas(
        lambda batches: _buckets_of_words(batches, buckets), "chunk long, places binary")

    def reassemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                counts = np.asarray(row.counts, np.int64)
                if row.answers is None or pd.isna(row.wide):  # no word at all
                    yield pd.DataFrame([{"docs": row.docs, "counts": np.zeros(len(counts), np.int32), "wide": 4, "ids": b""}])
                    continue
                own = _unpacked(row.places, "<u2")
                words: list[bytes] = [b""] * len(own)
                for found in row.answers:
                    for at, ids in zip(np.flatnonzero(own == found["bucket"]).tolist(), unpack_strings(found["ids"])):
                        words[at] = ids
                where = from_varints(_bytes(row.positions)).tolist()
                ids, at = [], 0
                for n in counts.tolist():
                    ids.append(b"".join(map(words.__getitem__, where[at:at + n])))
                    at += n
                wide = int(row.wide)
                yield pd.DataFrame([{"docs": row.docs, "counts": [len(i) // wide for i in ids], "wide": wide,
                                     "ids": b"".join(ids)}])

    joined = (staged.select("chunk", "docs", "counts", "positions").join(whose, "chunk").join(answers, "chunk", "left")
              .select("docs", "counts", "positions", "places", "wide", "answers"))
    return joined.mapInPandas(reassemble, "docs array<long>, counts array<int>, wide int, ids binary")


def _bytes(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def _buckets_of_words(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"chunk": batch["chunk"], "places": [
            _packed(np.array([bucket_of(w, buckets) for w in unpack_strings(words)], "<u2")) for words in batch["words"]]})


def per_document(encoded: DataFrame, spark: SparkSession, ranks: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the bytes
    that the ids give by the token-byte table) of each document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = load_ranks(ranks)  # the token-byte table: as many rows as the vocabulary
        top = max(table.values(), default=-1) + 1
        token = [b""] * top
        for word, rank in table.items():
            token[rank] = word
        decimal = [str(i).encode() for i in range(top)]
        for batch in batches:
            for docs, counts, wide, data in zip(batch["docs"], batch["counts"], batch["wide"].tolist(), batch["ids"]):
                flat, at, shown, decoded = np.frombuffer(data, f"<u{wide}"), 0, [], []
                for n in counts.tolist():
                    ids = flat[at:at + n].tolist()
                    at += n
                    shown.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(token.__getitem__, ids))).hexdigest())
                yield pd.DataFrame({key: pd.array(docs, "Int64"), "n_tokens": counts.astype(np.int64), "ids_sha256": shown,
                                    "decoded_sha256": decoded})

    return encoded.mapInPandas(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token files: each document's ids as a zstandard frame of its own, made with a dictionary that all documents share.

A store is a folder: ``dictionary`` (Parquet, one row: hash and bytes), ``files/*.zids`` (frames one after another) and
``index`` (Parquet): for each document its file, the frame's offset and length, the number of ids, the width of an id, the
dictionary's hash and the number of ids of all documents before it. A short document is read by one seek.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

from .words import crc_of_ids, encoder, forget, in_batches

#: The dictionary is fitted on so many documents at most, taken by hash among those of at most so many characters.
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 8_192
DICTIONARY_BYTES = 65_536
LEVEL = 3


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; samples that are too few or too small to train on serve as the dictionary themselves."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, text: str = "text", key: str = "doc_id") -> None:
    """Encode and write all documents in ascending key order, each with the end id appended.

    A null text is empty and leaves the end id alone; null keys come first; rows with equal keys follow one another in any
    order and are all kept; an empty table writes an empty index. Documents are exchanged once by key range; a key that
    very many rows share is spread over ranges. Files are named by attempt, and the index, which is committed by Spark,
    names only those of attempts that succeeded, so a task lost half-way leaves nothing that is read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashed = narrow.where(F.length("text") <= SAMPLE_CHARS).withColumn("h", F.xxhash64("text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    sample = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = encoder(tokenizer)
        data = train_dictionary([ids for batch in batches for ids in book.encode(batch["text"])])
        yield pd.DataFrame({"hash": [hashlib.sha256(data).hexdigest()], "bytes": [data]})

    sample.coalesce(1).mapInPandas(fit, "hash string, bytes binary").write.parquet(f"{folder}/dictionary")
    known = spark.read.parquet(f"{folder}/dictionary").first()
    name, shared = (known["hash"], bytes(known["bytes"])) if known else (hashlib.sha256(b"").hexdigest(), b"")
    held = spark.sparkContext.broadcast(shared)
    files = f"{folder}/files"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        book, system = encoder(tokenizer), _filesystem(files)
        tail = np.array([end], book.dtype).tobytes()
        # a dictionary is loaded once for all documents, and its hash stands in the index instead of each frame
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(held.value), write_dict_id=False)
        part, file, sink, at, before = TaskContext.get().partitionId(), "", None, 0, 0
        for batch in batches:
            texts = batch["text"].tolist()
            for piece in in_batches(texts):
                frames, sizes = [], []
                for ids in book.encode(texts[piece]):
                    frames.append(press.compress(ids + tail))
                    sizes.append((len(ids) + len(tail)) // book.dtype.itemsize)
                if sink is None:
                    file = f"{part:06d}-{uuid.uuid4().hex}.zids"
                    filesystem, root = system
                    filesystem.create_dir(root, recursive=True)
                    sink = filesystem.open_output_stream(f"{root}/{file}")
                sink.write(b"".join(frames))
                lengths, counts = np.array([len(f) for f in frames], np.int64), np.array(sizes, np.int64)
                yield pd.DataFrame({
                    "part": part, "file": file, "doc": batch["doc"].iloc[piece].astype("Int64"),
                    "at": at + np.cumsum(lengths) - lengths, "bytes": lengths, "n_tokens": counts,
                    "ahead": before + np.cumsum(counts) - counts, "wide": book.dtype.itemsize, "dictionary": name})
                at, before = at + int(lengths.sum()), before + int(counts.sum())
        if sink is not None:
            sink.close()

    spread = narrow.withColumn("spread", F.monotonically_increasing_id() % 1024)
    index = spread.repartitionByRange("doc", "spread").sortWithinPartitions("doc", "spread").mapInPandas(
        run, "part int, file string, doc long, at long, bytes long, n_tokens long, ahead long, wide int, dictionary string")
    rough = shared_dir(spark, "token-index")
    index.write.parquet(rough)
    index = spark.read.parquet(rough)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    (index.join(bases, "part").withColumn("start", F.col("ahead") + F.col("base")).drop("ahead", "base", "part")
     .withColumnRenamed("doc", key).write.parquet(f"{folder}/index"))


def _reader(folder: str, shared: bytes):
    import zstandard

    filesystem, root = _filesystem(f"{folder}/files")
    unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(shared))
    open_: dict[str, object] = {}

    def read(file: str, at: int, size: int) -> bytes:
        if file not in open_:
            for other in open_.values():
                other.close()
            open_.clear()
            open_[file] = filesystem.open_input_file(f"{root}/{file}")
        return unpress.decompress(open_[file].read_at(size, at))

    return read


def read(spark: SparkSession, folder: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """All documents of a store from its files: ``key``, ``start``, ``n_tokens``, ``wide`` and ``ids``, or with ``digest``
    ``ids_crc32`` (the ids as 32-bit integers) instead of the last two.

    One row for each document written, those with null or equal keys and empty texts too; an empty store gives no row. A
    file whose frames were made with another dictionary than the store's is refused.
    """
    known = spark.read.parquet(f"{folder}/dictionary").first()
    shared = bytes(known["bytes"]) if known else b""
    name = hashlib.sha256(shared).hexdigest()
    held = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        read_frame = _reader(folder, held.value)
        for batch in batches:
            if (batch["dictionary"] != name).any():
                raise ValueError("the index names another dictionary")
            for at in range(0, len(batch), 500):
                rows = batch.iloc[at:at + 500]
                wide = rows["wide"].tolist()
                found = map(read_frame, rows["file"], rows["at"].tolist(), rows["bytes"].tolist())
                out = pd.DataFrame({key: rows[key].astype("Int64"), "start": rows["start"], "n_tokens": rows["n_tokens"]})
                if digest:
                    yield out.assign(ids_crc32=np.array(list(map(crc_of_ids, wide, found)), np.int64))
                else:
                    yield out.assign(wide=wide, ids=list(found))

    last = "ids_crc32 long" if digest else "wide int, ids binary"
    return spark.read.parquet(f"{folder}/index").mapInPandas(run, f"`{key}` long, start long, n_tokens long, {last}")


def read_one(spark: SparkSession, folder: str, doc: int, key: str = "doc_id") -> list[int]:
    """The ids of one document, by its entry in the index and one read of its frame."""
    row = spark.read.parquet(f"{folder}/index").where(F.col(key) == doc).first()
    known = spark.read.parquet(f"{folder}/dictionary").first()
    if row is None:
        raise KeyError(doc)
    frame = _reader(folder, bytes(known["bytes"]) if known else b"")(row["file"], row["at"], row["bytes"])
    return np.frombuffer(frame, f"<u{row['wide']}").tolist()

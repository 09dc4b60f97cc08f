"""Masked pseudo-likelihood: a bidirectional window network that predicts every character class from both sides.

Texts are read as classes of characters: the letters a to z (case and accents folded), white space, digits, sentence
marks, other marks, other letters, anything else, and the border of a text. The network sees two classes to the left and
two to the right of a masked one through position-wise embeddings, a hidden layer and a softmax. It is trained on counts
of all windows of all documents, gathered by one aggregation. As there are 32 classes, there are at most 2^20 contexts:
workers tabulate the network's log-probabilities once and score whole texts by lookup.
"""
from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

CLASSES = 32
SPACE, DIGIT, SENTENCE, MARK, LETTER, OTHER = range(26, 32)
BORDER = OTHER
SIDE = 2
#: Log-probabilities are kept in steps of 1/STEPS, so that sums do not depend on order.
STEPS = 1024
HIDDEN = 32
PARTS = 8
ROUNDS = 5
EPOCHS = 2
BATCH = 1024
RATE = 0.01
#: Characters taken at once.
STRETCH = 1 << 20

_TABLES: dict[str, np.ndarray] = {}
_CLASS_OF: list[np.ndarray] = []


def _class(c: str) -> int:
    base = unicodedata.normalize("NFKD", c)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - ord("a")
    if c.isspace():
        return SPACE
    kind = unicodedata.category(c)
    if kind[0] == "N":
        return DIGIT
    if c in ".,;:!?":
        return SENTENCE
    return MARK if kind[0] in "PS" else LETTER if kind[0] == "L" else OTHER


def classes_of(text: str | None) -> np.ndarray:
    """The class of every character of a whole text; a null text has none. Characters past U+FFFF are of class OTHER."""
    if not _CLASS_OF:
        _CLASS_OF.append(np.array([OTHER if 0xD800 <= i < 0xE000 else _class(chr(i)) for i in range(1 << 16)] + [OTHER],
                                  np.uint8))
    points = np.frombuffer(("" if text is None else text).encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS_OF[0][np.minimum(points, 1 << 16)]


def windows_of(classes: np.ndarray) -> np.ndarray:
    """For each character its context (20 bits: two classes before, two after) and, in the low 5 bits, its own class."""
    padded = np.concatenate([np.full(SIDE, BORDER, np.uint8), classes, np.full(SIDE, BORDER, np.uint8)]).astype(np.int32)
    n = len(classes)
    code = np.zeros(n, np.int32)
    for at in (0, 1, 3, 4, 2):
        code = code << 5 | padded[at:at + n]
    return code


def count_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``context``, ``own`` (class of the masked character) and ``n``: counts over all documents and whole texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        codes, counts = np.empty(0, np.int32), np.empty(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(held), return_counts=True)
            both, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)

        waiting = 0
        for batch in batches:
            for one in batch["text"]:
                held.append(windows_of(classes_of(one)))
                waiting += len(held[-1])
                if waiting >= 4 * STRETCH:
                    codes, counts = merged()
                    held, waiting = [], 0
        if held:
            codes, counts = merged()
        if len(codes):
            yield pd.DataFrame({"code": codes, "n": counts})

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(run, "code int, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n")).select(
        F.shiftright("code", 5).alias("context"), F.col("code").bitwiseAND(CLASSES - 1).alias("own"), "n")


class Network:
    """Weights: ``e`` embeds the four classes around, ``b`` their bias, ``u`` and ``c`` lead from the hidden layer to the
    classes."""

    def __init__(self, weights: np.ndarray | None = None, seed: int = 7) -> None:
        sizes = [(2 * SIDE * CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = np.concatenate([(rng.standard_normal(s) * (0.3 if len(s) > 1 else 0)).ravel() for s in sizes])
        self.weights = weights.astype(np.float64)
        ends = np.cumsum([int(np.prod(s)) for s in sizes])
        self.e, self.b, self.u, self.c = [
            part.reshape(s) for part, s in zip(np.split(self.weights, ends[:-1]), sizes)]

    @staticmethod
    def inputs(contexts: np.ndarray) -> np.ndarray:
        return np.stack([(contexts >> 15 & 31), (contexts >> 10 & 31) + 32, (contexts >> 5 & 31) + 64, (contexts & 31) + 96],
                        axis=1)

    def hidden(self, at: np.ndarray) -> np.ndarray:
        return np.tanh(self.e[at].sum(1) + self.b)

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        scores = self.hidden(self.inputs(contexts)) @ self.u + self.c
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))

    def gradient(self, contexts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability of the counted classes."""
        at = self.inputs(contexts)
        hidden = self.hidden(at)
        scores = hidden @ self.u + self.c
        scores = np.exp(scores - scores.max(1, keepdims=True))
        total = counts.sum(1, keepdims=True)
        d_scores = (scores / scores.sum(1, keepdims=True) * total - counts) / total.sum()
        d_hidden = d_scores @ self.u.T * (1 - hidden * hidden)
        d_e = np.zeros_like(self.e)
        for k in range(at.shape[1]):
            np.add.at(d_e, at[:, k], d_hidden)
        return np.concatenate([d_e.ravel(), d_hidden.sum(0), (hidden.T @ d_scores).ravel(), d_scores.sum(0)])


def _improved(weights: np.ndarray, contexts: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """Adam over mini-batches of contexts, the frequent ones drawn together with rare ones in a fixed shuffled order."""
    weights, rng = weights.copy(), np.random.default_rng(seed)
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(contexts))
        for at in range(0, len(order), BATCH):
            use = order[at:at + BATCH]
            g = Network(weights).gradient(contexts[use], counts[use])
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            weights = weights - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return weights


def _round(held: Broadcast, number: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("context")
        counts = np.stack(rows["counts"].to_numpy()).astype(float)
        better = _improved(held.value, rows["context"].to_numpy(np.int64), counts, 1000 * number + int(key[0]))
        return pd.DataFrame({"part": [int(key[0])], "mass": [counts.sum()], "weights": [better.tolist()]})

    return run


def train(counted: DataFrame) -> np.ndarray:
    """The network's weights from counts of windows.

    Contexts with their 32 counts (2^20 rows at most, whatever the corpus) are written in PARTS parts. In each round
    every part improves the current weights by itself, and the results are averaged by the characters counted. Without
    any window the weights are the first ones.
    """
    spark = counted.sparkSession
    path = shared_dir(spark, "window-counts")
    wide = counted.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("own", "n"))).alias("m"))
    (wide.select("context", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.coalesce(
        F.col("m")[i], F.lit(0))).alias("counts"), (F.col("context") % PARTS).alias("part"))
     .repartition("part").sortWithinPartitions("part", "context").write.parquet(path))
    stored = spark.read.parquet(path)
    weights = Network().weights
    for number in range(ROUNDS):
        held = spark.sparkContext.broadcast(weights)
        results = stored.groupBy("part").applyInPandas(
            _round(held, number), "part int, mass double, weights array<double>").collect()
        if not results:
            break
        results.sort(key=lambda r: r["part"])
        mass = np.array([r["mass"] for r in results])
        weights = (np.array([r["weights"] for r in results]) * (mass / mass.sum())[:, None]).sum(0)
    return weights


def table_of(weights: np.ndarray) -> np.ndarray:
    """Log-probability, in steps, of each class in each context; kept by the worker."""
    name = hashlib.sha256(weights.tobytes()).hexdigest()
    if name not in _TABLES:
        _TABLES.clear()
        network, made = Network(weights), np.empty((1 << 20, CLASSES), np.int16)
        for at in range(0, 1 << 20, 1 << 14):
            steps = np.rint(network.log_probabilities(np.arange(at, at + (1 << 14))) * STEPS)
            made[at:at + (1 << 14)] = np.maximum(steps, -32768)
        _TABLES[name] = made.ravel()
    return _TABLES[name]


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, ``log_likelihood`` (the sum over the whole text) and ``mean_log_likelihood``.

    A null or empty text has no tokens, a sum of zero and a null mean. Keys may be null or repeat; each row is scored by
    itself, so equal texts score alike; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = table_of(held.value)
        for batch in batches:
            sizes, sums = [], []
            for one in batch["text"]:
                codes = windows_of(classes_of(one))
                sizes.append(len(codes))
                sums.append(int(table[codes].sum(dtype=np.int64)))
            yield pd.DataFrame({"key": batch["key"].astype("Int64"), "n_tokens": sizes, "steps": sums})

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    scored = narrow.mapInPandas(run, "key long, n_tokens long, steps long")
    total = F.col("steps") / F.lit(float(STEPS))
    return scored.select(F.col("key").alias(key), "n_tokens", total.alias("log_likelihood"),
                         F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))


def score_by_own_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Train on all documents, score all documents."""
    path = shared_dir(docs.sparkSession, "windows")
    count_windows(docs, text).write.parquet(path)
    return score(docs, train(docs.sparkSession.read.parquet(path)), text, key)

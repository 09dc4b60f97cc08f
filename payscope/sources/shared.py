"""Folders that the driver and all executors share."""
from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
AT_ONCE = 4  # steps that plan and run side by side
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_turning = threading.Lock()
_dropping: dict[int, tuple[int, str]] = {}  # for each session how many ask for the setting, and its value before them


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, only a session in one process (``local[...]``) gets a folder of its own; a cluster
    must name one, because each machine would otherwise write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="payscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it ends, not when the driver happens to collect garbage.

    The setting is the session's: what other threads begin meanwhile drops its files as well, and makes them anew if it
    is read again.
    """
    with _turning:
        users, before = _dropping.get(id(spark)) or (0, spark.conf.get(DROP_SHUFFLES))
        _dropping[id(spark)] = users + 1, before
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _turning:
            users, before = _dropping.pop(id(spark))
            if users > 1:
                _dropping[id(spark)] = users - 1, before
            else:
                spark.conf.set(DROP_SHUFFLES, before)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what is used several times is computed once, the plan above
    it stays small, and a lost executor costs no more than its own tasks. This runs a job, whose shuffle files go with it."""
    spark = rows.sparkSession
    path = shared_dir(spark, name)
    with dropping_shuffles(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def together(spark: SparkSession, steps: Sequence[Callable[[], T]]) -> list[T]:
    """What the steps return, in their order. They run side by side, a few at a time: each plans on the driver and runs small
    jobs, which one after another leave most cores idle. Steps must not need one another."""
    if len(steps) < 2:
        return [step() for step in steps]

    def inheriting(step: Callable[[], T]) -> Callable[[], T]:
        """The step with the caller's job group, properties and tags; without pinned threads there are none to hand on."""
        wrap = inheritable_thread_target(spark)
        return wrap(step) if callable(wrap) else step

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [done.result() for done in [pool.submit(inheriting(step)) for step in steps]]

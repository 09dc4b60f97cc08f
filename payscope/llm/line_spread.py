"""Line dedup by distinct-site spread: lines found on many sites are boilerplate; only their first occurrence stays."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.sources.tables import shared_dir

#: A line on at least so many sites is boilerplate, if it has so many words.
MIN_SITES = 4
MIN_WORDS = 3
#: Sketch size (a power of two of registers) and the standard errors within which an estimate counts as near.
REGISTERS = 10
NEAR_ERRORS = 4.0


def _keyed(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    row = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    return row.select("row", F.col(f"row.`{key}`").cast("long").alias("doc"), F.col(f"row.`{site}`").cast("string").alias("site"),
                      body.alias("text"), F.xxhash64(body).alias("digest"))


def _lines(keyed: DataFrame, min_words: int) -> DataFrame:
    """One row for each line that has enough words: document, line number, site and the line's two hashes."""
    lines = keyed.select("doc", "digest", "site", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    bare = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[\x09-\x0D]", " ")))
    return (bare.where((F.col("line") != "") & (F.size(F.split("line", " +")) >= min_words))
            .select("doc", "digest", "no", "site", F.xxhash64("line").alias("line"),
                    F.hash("line", F.lit(1)).alias("check")))


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Lines on at least ``min_sites`` sites: ``line``, ``check`` and the ``first`` occurrence (document, digest, number).

    One HyperLogLog sketch of sites for each line, merged by aggregation. An estimate clearly above the threshold
    decides; one within NEAR_ERRORS standard errors of it (and one site at least) is replaced by the exact count, made
    from the occurrences of the lines concerned alone. Null sites count as no site.
    """
    error = 1.04 / math.sqrt(1 << REGISTERS)
    margin = max(1.0, NEAR_ERRORS * error * min_sites)
    path = shared_dir(lines.sparkSession, "line-sketches")
    sketched = lines.groupBy("line", "check").agg(
        F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"), F.min(F.struct("doc", "digest", "no")).alias("first"))
    (sketched.select("line", "check", "first", F.hll_sketch_estimate("sketch").alias("sites"))
     .where(F.col("sites") >= min_sites - margin).write.parquet(path))
    found = lines.sparkSession.read.parquet(path)
    near = F.col("sites") <= min_sites + margin
    doubtful = found.where(near).select("line", "check")
    exact = (lines.select("line", "check", "site").join(doubtful, ["line", "check"], "left_semi").distinct()
             .groupBy("line", "check").agg(F.count("site").alias("exact")))
    return (found.join(exact, ["line", "check"], "left")
            .where(F.coalesce(F.when(near, F.coalesce("exact", F.lit(0))), F.col("sites")) >= min_sites)
            .select("line", "check", "first"))


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id",
                       min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the document's columns, its text as it was), ``clean`` (the text without the lines removed) and
    ``n_lines`` and ``n_removed``.

    Lines are parted by U+000A and compared without white space around them; lines of fewer than ``min_words`` words are
    never removed. Of a line on ``min_sites`` sites or more the first occurrence stays (smallest key, then text hash,
    then line number; a null key comes first) and all others go, so that of many copies one keeps its lines. A null text
    stays null and has no lines. Rows repeat as they were; rows equal in key and text share their fate. Hot lines are
    aggregated where they are read; only verdicts and, once, the documents that are joined with them move.
    """
    keyed = _keyed(docs, text, site, key)
    lines = _lines(keyed, min_words)
    path = shared_dir(docs.sparkSession, "boilerplate-lines")
    spread(lines, min_sites).write.parquet(path)
    boilerplate = docs.sparkSession.read.parquet(path)
    here = F.struct("doc", "digest", "no")
    gone = lines.join(boilerplate, ["line", "check"]).where(~here.eqNullSafe(F.col("first")))
    verdict = (gone.groupBy("digest", "doc").agg(F.collect_set("no").alias("gone"))
               .withColumnsRenamed({"digest": "vdigest", "doc": "vdoc"}))
    joined = keyed.join(verdict, (F.col("digest") == F.col("vdigest")) & F.col("doc").eqNullSafe(F.col("vdoc")), "left")
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i))
    given = F.col(f"row.`{text}`")
    return joined.select(
        "row", F.when(F.col("gone").isNull(), given).otherwise(F.array_join(kept, "\n")).alias("clean"),
        F.when(given.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents with their own columns and the cleaned text."""
    return remove_boilerplate(docs, text, site, key).select(
        *[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

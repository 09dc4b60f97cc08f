"""Plain text of stored documents, a term index over it, and ranked search."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
# Markup removed in order: (pattern, replacement).
MARKUP = [(r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "),
          (r"<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
          ("&amp;", "&"), (r"[ \t\n\r\f]+", " ")]


def doc_text_extract(html: Column) -> Column:
    text = html
    for pattern, replacement in MARKUP:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def _words(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"),
                       F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)).alias("term"))


def doc_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Postings (term, doc_id, tf) with the term's document frequency.

    The frequency counts postings by ``tf``, which every one has: with the same columns both uses of the postings share one
    shuffle, where a plain count would make Spark read and shuffle all texts again without it.
    """
    postings = _words(docs, doc, text).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return postings.join(postings.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df")), "term")


def write_index(docs: DataFrame, doc: str, text: str, folder: str) -> None:
    """Store the index: ``postings``, sorted by term so that a search reads few row groups, and ``lengths``."""
    (doc_index(docs, doc, text).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
     .write.parquet(f"{folder}/postings"))
    (docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.size(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)), F.lit(0))
                 .alias("len")).write.parquet(f"{folder}/lengths"))


def doc_search(spark: SparkSession, folder: str, terms: Sequence[str], k: int, k1: float = 1.2,
               b: float = 0.75) -> DataFrame:
    """Top ``k`` documents by BM25 from a stored index: postings of the query's terms and the documents' lengths."""
    lengths = spark.read.parquet(f"{folder}/lengths")
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("len")).first()
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("term").isin(*sorted(set(terms))))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
    return (postings.join(lengths, "doc_id").groupBy("doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
            .orderBy(F.col("score").desc(), "doc_id").limit(k))

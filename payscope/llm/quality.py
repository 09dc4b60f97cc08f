"""Quality rules: a table of thresholds compiled into Spark projections, without user functions."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: Common words of the corpus languages; a text in one of them uses some.
STOP_WORDS = ("the be to of and that have with a in is it "
              "le la les de des du et un une que en est "
              "der die das und zu den von mit ist ein sich nicht "
              "el los las del y que se por con su al una").split()


@dataclass(frozen=True)
class Limit:
    """A measure, or two of them with a slash between, and the bounds (inclusive) within which a text passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The method's verdict. Values are those customary for web text; languages with long compounds set the word length.
THRESHOLDS = (
    Limit("n_words", 20, None),
    Limit("word_chars / n_words", 2.0, 14.0),
    Limit("n_symbols / n_words", None, 0.1),
    Limit("n_stop_words", 2, None),
    Limit("n_alpha_words / n_words", 0.6, None),
    Limit("n_dup_lines / n_lines", None, 0.3),
    Limit("n_bullet_lines / n_lines", None, 0.9),
    Limit("n_ellipsis_lines / n_lines", None, 0.3),
)


def compile_limits(limits: tuple[Limit, ...]) -> Column:
    """One condition: every metric lies within its bounds; a metric without a value (nothing to divide by) passes."""
    passed = F.lit(True)
    for limit in limits:
        parts = [F.col(f"quality.{name.strip()}") for name in limit.metric.split("/")]
        value = parts[0] if len(parts) == 1 else parts[0].cast("double") / F.nullif(parts[1].cast("double"), F.lit(0.0))
        for bound, meets in ((limit.low, lambda v, b: v >= b), (limit.high, lambda v, b: v <= b)):
            if bound is not None:
                passed = passed & F.coalesce(meets(value, F.lit(float(bound))), F.lit(True))
    return passed


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once and not for each use inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paired(hashes: str, apart: int) -> Column:
    """Each hash mixed with the one ``apart`` places on: hashes of windows become hashes of windows twice as wide. The
    last ``apart`` have no partner and are cut off in the end."""
    shifted = F.slice(hashes, apart + 1, F.greatest(F.size(hashes) - apart, F.lit(0)))
    return F.zip_with(hashes, shifted, lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words lying in windows that occur more than once. Windows are sorted with their positions; those equal to a
    neighbour are repeated, and each repeated window adds the words from the end of the last one on."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        return F.array_sort(F.transform(F.filter(
            F.transform(ordered, lambda x, k: F.struct(x["i"].alias("i"), (
                F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))

    def added(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(
            i - F.get(starts, k - 1), F.lit(WINDOW)))), F.lit(0).cast("long"), lambda total, n: total + n)

    return _let(_let(placed, repeated), added)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document: ``row``, a struct of all its columns, and ``quality``, measures of the whole text.

    Words are maximal runs of characters other than space and U+0009-U+000D; lines are parted by U+000A. A null text
    measures like an empty one: zeros. Rows are measured by themselves, so ties and repeated rows play no part; names of
    other columns cannot clash, as they stay inside ``row``. Windows of eight words are compared by 64-bit hash inside
    one text.
    """
    staged = (docs.select(F.struct("*").alias("row")).withColumn("text", F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
              .withColumn("words", F.array_remove(F.split("text", WORD_BREAK, -1), ""))
              .withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
              .withColumn("windows", F.transform("words", lambda w: F.xxhash64(w)))
              .withColumn("windows", _paired("windows", 1)).withColumn("windows", _paired("windows", 2))
              .withColumn("windows", _paired("windows", 4))
              .withColumn("windows", F.slice("windows", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))))
    stop = F.array(*[F.lit(w) for word in dict.fromkeys(STOP_WORDS) for w in (word, word.capitalize())])
    return staged.select("row", F.struct(
        _count(F.col("words")).alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("windows"))).alias("n_repeat_words"),
        _count(F.col("lines")).alias("n_lines"),
        _count(F.array_intersect("words", stop)).alias("n_stop_words"),
        _count(F.filter("words", lambda w: w.rlike(r"\p{L}"))).alias("n_alpha_words"),
        _count(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•●]"))).alias("n_bullet_lines"),
        _count(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
    ).alias("quality"))


def judged(docs: DataFrame, text: str = "text", limits: tuple[Limit, ...] = THRESHOLDS) -> DataFrame:
    """``row`` and ``quality`` (see :func:`measure`), ``base_failed`` and ``kept``.

    A text fails the base rules with under 20 words, or with more than 30 % of its words in repeated windows. It is kept
    if it passes these and every limit. An empty table gives an empty table.
    """
    n, repeated = F.col("quality.n_words"), F.col("quality.n_repeat_words")
    failed = (n < 20) | (repeated * 100 > n * 30)
    return (measure(docs, text).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & compile_limits(limits)))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the table's own columns.

    The verdict passes a one-element generator: a filter would otherwise be pushed below the measures and compute the
    words again for each limit.
    """
    verdict = judged(docs, text).select("row", F.explode(F.array("kept")).alias("kept"))
    return verdict.where("kept").select("row.*")

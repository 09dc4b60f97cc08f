"""Functions offered to rule authors, by group: names and behaviour of the authoring palette as Column builders."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalar import haversine

MATH: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt, "abs": F.abs, "pow": F.pow, "sin": F.sin, "cos": F.cos, "asin": F.asin}


def js_slice(text: Column, start: int, end: int | None = None) -> Column:
    """Substring with end exclusive; negative positions count from the end."""
    size = F.length(text)
    place = lambda p: F.greatest(size + p, F.lit(0)) if p < 0 else F.least(size, F.lit(p))
    lo, hi = place(start), size if end is None else place(end)
    return F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))


STRING: dict[str, Callable[..., Column]] = {
    "split": lambda s, sep: F.split(s, sep), "slice": js_slice, "trim": F.trim,
    "substring": lambda s, a, b: F.substring(s, F.lit(min(a, b) + 1), F.lit(abs(b - a))),
    "toUpperCase": F.upper, "toLowerCase": F.lower, "toString": lambda c: c.cast("string"), "length": F.length}


def _no_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


ARRAY: dict[str, Callable[..., Column]] = {
    "pop": _no_last, "push": F.array_append, "reverse": F.reverse, "flat": F.flatten, "concat": F.concat,
    "findIndex": lambda a, v: F.array_position(a, v) - 1, "length": F.size}

LOOP: dict[str, Callable[..., Column]] = {
    "map": F.transform, "filter": F.filter, "every": F.forall, "some": F.exists,
    "reduce": lambda a, zero, merge: F.aggregate(a, zero, merge),
    "find": lambda a, test: F.get(F.filter(a, test), 0), "forEach": F.explode}

OBJECT: dict[str, Callable[..., Column]] = {
    "keys": F.map_keys, "values": F.map_values, "entries": F.map_entries,
    "assign": lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b),
    "hasOwnProperty": F.map_contains_key}


def branch(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    """if / else-if chains and nested ternaries."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def array_stddev(values: Column) -> Column:
    """Population standard deviation of an array; 0 when empty."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when(n > 0, F.sqrt(spread)).otherwise(F.lit(0.0))


def population_stddev(value: Column) -> Column:
    """The same as an aggregate."""
    return F.coalesce(F.stddev_pop(value), F.lit(0.0))


def count_matching(values: Column, tolerance: float) -> Column:
    """How many values lie within ``tolerance`` (a share) of the first one, itself included."""
    first = F.get(values, 0)
    return F.size(F.filter(values, lambda v: F.abs(v - first) <= first * tolerance))


def map_amounts(values: Column) -> tuple[Column, Column]:
    """Values as numbers and whether any of them is not one."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    return numbers, F.exists(numbers, lambda v: v.isNull() | F.isnan(v))


def fn_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """Parameterised query against history tables; parameters are bound, not pasted."""
    return spark.sql(query, args=args, **tables)


__all__ = ["MATH", "STRING", "ARRAY", "LOOP", "OBJECT", "branch", "array_stddev", "population_stddev",
           "count_matching", "map_amounts", "fn_sql", "haversine", "js_slice"]

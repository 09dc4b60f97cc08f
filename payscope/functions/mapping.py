"""Functions that a payload mapping may name: a chain of typed steps, compiled to one Column.

A step is {"name": n, "args": [...]}. The first step takes the sources, each next one the value before. Every function
states the types it takes and gives; steps that do not fit, wrong arguments and unknown names are refused before any row
is read. The set of functions is ours.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, NUMBER, MANY = "string", "decimal(38,10)", "several texts"


@dataclass(frozen=True)
class Function:
    takes: str
    gives: str
    args: tuple[type | tuple[type, ...], ...]
    build: Callable[..., Column]


_NUMERIC = (int, float)
REGISTRY: dict[str, Function] = {
    "concat": Function(MANY, TEXT, (str,), lambda v, mark: F.concat_ws(mark, *v)),
    "first": Function(MANY, TEXT, (), lambda v: F.coalesce(*v)),
    "sum": Function(MANY, NUMBER, (), lambda v: sum((x.try_cast(NUMBER) for x in v[1:]), v[0].try_cast(NUMBER)).cast(NUMBER)),
    "upper": Function(TEXT, TEXT, (), F.upper),
    "lower": Function(TEXT, TEXT, (), F.lower),
    "trim": Function(TEXT, TEXT, (), F.trim),
    "substring": Function(TEXT, TEXT, (int, int), lambda v, at, n: F.substring(v, at + 1, n)),
    "replace": Function(TEXT, TEXT, (str, str), lambda v, old, new: F.replace(v, F.lit(old), F.lit(new))),
    "part": Function(TEXT, TEXT, (str, int), lambda v, mark, n: F.get(F.split(v, re.escape(mark)), n)),
    "default": Function(TEXT, TEXT, (str,), lambda v, other: F.coalesce(F.nullif(v, F.lit("")), F.lit(other))),
    "lookup": Function(TEXT, TEXT, (dict,), lambda v, table: F.coalesce(*[
        F.when(v == k, F.lit(x)) for k, x in table.items()], F.lit(None).cast("string"))),
    "number": Function(TEXT, NUMBER, (), lambda v: v.try_cast(NUMBER)),
    "multiply": Function(NUMBER, NUMBER, (_NUMERIC,), lambda v, x: (v * F.lit(str(x)).cast("decimal(18,6)")).cast(NUMBER)),
    "add": Function(NUMBER, NUMBER, (_NUMERIC,), lambda v, x: (v + F.lit(str(x)).cast(NUMBER)).cast(NUMBER)),
    "round": Function(NUMBER, NUMBER, (int,), lambda v, n: F.round(v, n).cast(NUMBER)),
    "abs": Function(NUMBER, NUMBER, (), F.abs),
    "text": Function(NUMBER, TEXT, (int,), lambda v, n: F.round(v, n).cast(f"decimal(38,{n})").cast("string")),
}


def _checked(step: Mapping, kind: str) -> tuple[Function, list]:
    name, args = step.get("name"), list(step.get("args") or [])
    function = REGISTRY.get(name)
    if function is None:
        raise ValueError(f"unknown mapping function {name}")
    if function.takes != kind:
        raise ValueError(f"{name} takes {function.takes}, not {kind}")
    fits = len(args) == len(function.args) and all(
        isinstance(a, t) and not isinstance(a, bool) for a, t in zip(args, function.args))
    if not fits:
        raise ValueError(f"{name} does not take the arguments {args}")
    return function, args


def apply(sources: Sequence[Column], steps: Sequence[Mapping]) -> Column:
    """The steps over the sources, which are texts. With one source the first step may take a text."""
    value: object = list(sources)
    kind = MANY
    first = REGISTRY.get(steps[0].get("name"))
    if len(sources) == 1 and first is not None and first.takes == TEXT:
        value, kind = sources[0], TEXT
    for step in steps:
        function, args = _checked(step, kind)
        value, kind = function.build(value, *args), function.gives
    return value

"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is rendered: ``before`` role ``between`` text ``after``. Text and ``after`` of these roles are trained."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)


CHAT = Template()


def _rendered(turn: Column, form: Template) -> Column:
    return F.concat(F.lit(form.before), turn["role"], F.lit(form.between), turn["text"], F.lit(form.after))


def _completion(turns: Column, form: Template) -> tuple[Column, Column]:
    """The text of the turns, and the spans of it that are trained, as (start, end) in characters."""
    head = F.lit(len(form.before) + len(form.between))
    tail = F.lit(len(form.after))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + head + F.length(turn["role"])
        end = begin + F.length(turn["text"]) + tail
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"].isin(*form.trained), F.concat(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return (F.array_join(F.transform(turns, lambda t: _rendered(t, form)), ""),
            F.aggregate(turns, empty, step, lambda state: state["spans"]))


def format_pairs(turns: DataFrame, form: Template = CHAT) -> DataFrame:
    """One row for each pair: ``pair_id``, ``n_prompt_turns``, ``prompt``, ``chosen``, ``rejected``, ``chosen_spans`` and
    ``rejected_spans``.

    ``turns`` has ``pair_id``, ``is_chosen``, ``turn``, ``role`` and ``text``; other columns are not read. Turns are
    ordered by (turn, role, text). The prompt is the longest prefix of turns equal in role and text on both sides,
    rendered once and never trained; the completions are what follows on each side. A null role or text is empty, a null
    turn number comes first, rows without a pair or side belong to no conversation and are left out. Of a side that is
    missing the completion is empty. Repeated turns stay. Rows of a pair come together by one aggregation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda chosen: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_chosen") == chosen, turn))),
                                      lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    known = turns.where(F.col("pair_id").isNotNull() & F.col("is_chosen").isNotNull())
    pairs = known.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    equal = F.transform(F.arrays_zip(F.slice("c", 1, shorter).alias("a"), F.slice("r", 1, shorter).alias("b")),
                        lambda x: x["a"] == x["b"])
    first = F.array_position(equal, False)
    shared = F.when(first == 0, shorter).otherwise(first - 1).cast("int")
    cut = pairs.withColumn("n", shared)
    rest = lambda name: F.slice(name, F.col("n") + 1, F.size(name) - F.col("n"))
    parts = cut.select("pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    chosen, chosen_spans = _completion(F.col("c"), form)
    rejected, rejected_spans = _completion(F.col("r"), form)
    return parts.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _completion(F.col("p"), form)[0].alias("prompt"),
        chosen.alias("chosen"), rejected.alias("rejected"), chosen_spans.alias("chosen_spans"),
        rejected_spans.alias("rejected_spans"))


def with_partner_endings(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs from a table of conversations (``conv_id``, ``turn``, ``role``, ``text``).

    Chosen is each conversation as it is; rejected is the same with its last turn replaced by the last turn of its
    partner, the conversation whose id differs in the lowest bit. Without a partner the rejected side just ends earlier.
    Rows without ``conv_id`` are left out; of several last turns with the same number the greatest by role and text is
    the last.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = rows.groupBy("conv_id").agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("last").alias("theirs"))
    ends = last.join(partner, "conv_id", "left")
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit(True).alias("is_chosen"), "turn", "role", "text")
    early = (rows.select("*", order.alias("this")).join(ends.select("conv_id", "last"), "conv_id")
             .where(~F.col("this").eqNullSafe(F.col("last")))
             .select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("is_chosen"), "turn", "role", "text"))
    swapped = ends.where("theirs is not null").select(
        F.col("conv_id").alias("pair_id"), F.lit(False).alias("is_chosen"), F.col("last.turn").alias("turn"),
        "theirs.role", "theirs.text")
    return chosen.unionByName(early).unionByName(swapped)

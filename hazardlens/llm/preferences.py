"""Preference formatting of chosen and rejected conversations.

Turns of both sides are grouped by pair; the longest prefix of equal turns is rendered once as the prompt,
what follows on each side is its completion, with the spans that a model is trained on: the assistant's text
and its end mark. Everything is column functions; a pair is one group of one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """A null is empty; a mark inside a text is broken up, so that it can't pose as a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), _clean(turn["role"]), F.lit("\n"), _clean(turn["text"]), F.lit(TURN_END + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """'start:end' code points in the completion of each trained turn's text and end mark, by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(rendered(turn))
        begin = end - F.length(_clean(turn["text"])) - F.lit(len(TURN_END) + 1)
        span = F.concat_ws(":", begin.cast("string"), (end - F.lit(1)).cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"].eqNullSafe(trained_role), F.array_append(
            state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_column: str = "conv_id",
                     trained_role: str = "assistant") -> DataFrame:
    """(pair, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    Both tables hold (pair, turn, role, text), extra columns are left behind. Turns are ordered by turn, then
    role, then text, nulls first; rows that repeat a turn whole count once. Two turns are equal when role and
    text are (null equals null only). A pair that one side lacks has an empty completion there, and one whose
    sides are equal has two. A null pair id is a pair of its own.
    """
    def side(frame: DataFrame, flag: bool) -> DataFrame:
        return frame.select(F.col(pair_column).alias("pair"), F.lit(flag).alias("is_chosen"),
                            F.struct("turn", "role", "text").alias("entry"))

    turns = (side(chosen, True).unionByName(side(rejected, False)).groupBy("pair").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_chosen"), F.col("entry")))).alias("c"),
        F.array_sort(F.collect_set(F.when(~F.col("is_chosen"), F.col("entry")))).alias("r")))
    both = F.arrays_zip("c", "r")
    differs = F.transform(both, lambda x: ~(
        x["c"].isNotNull() & x["r"].isNotNull() & x["c"]["role"].eqNullSafe(x["r"]["role"])
        & x["c"]["text"].eqNullSafe(x["r"]["text"])))
    place = F.array_position(differs, True)
    n = F.when(place > 0, place - 1).otherwise(F.size("c")).cast("int")
    cut = turns.withColumn("n", n)
    tail = {k: F.slice(F.col(k), F.col("n") + 1, F.size(k)) for k in "cr"}
    return cut.select(
        "pair", F.col("n").alias("n_prompt_turns"), (F.size("c") - F.col("n")).alias("n_chosen_turns"),
        (F.size("r") - F.col("n")).alias("n_rejected_turns"),
        _joined(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), _joined(tail["c"]).alias("chosen"),
        _joined(tail["r"]).alias("rejected"), _spans(tail["c"], trained_role).alias("chosen_spans"),
        _spans(tail["r"], trained_role).alias("rejected_spans"))


def stale_replies(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """A rejected side for conversations that come without one: the last reply becomes the first one again.

    A conversation of one reply gets that reply's first half (code points, rounded down); one of none is as it was.
    """
    replies = conversations.where(F.col("role") == trained_role).groupBy("conv_id").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.min_by("text", F.struct("turn", "text")).alias("first_text"))
    text = (F.when((F.col("role") != trained_role) | F.col("last_turn").isNull() | (F.col("turn") != F.col("last_turn")),
                   F.col("text"))
            .when(F.col("first_turn") < F.col("last_turn"), F.col("first_text"))
            .otherwise(F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))))
    replies = replies.withColumnRenamed("conv_id", "reply_conv")
    return conversations.join(replies, F.col("conv_id").eqNullSafe(F.col("reply_conv")), "left").select(
        "conv_id", "turn", "role", text.alias("text"))

"""Preference pairs as a shared prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as
the prompt; what follows in each is its completion. The result has one row per rendered turn, so a
conversation of any length is never one row or one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.joins import with_position

LEARNED_ROLE = "assistant"


def _placed(turns: DataFrame, key: str) -> DataFrame:
    """Turns (pair_id, turn, role, text) with their 0-based place; ties by role and text."""
    order = Window.partitionBy(key).orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return turns.withColumn("place", F.row_number().over(order).cast("long") - 1)


def render(role: Column, text: Column) -> tuple[Column, Column]:
    """Header and body of a turn as text."""
    header = F.concat(F.lit("<|start|>"), F.coalesce(role, F.lit("")), F.lit("\n"))
    return header, F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of rendered turns from two tables (pair_id, turn, role, text) of conversations.

    Returns (pair_id, part, place, role, rendered, start, loss_start, loss_length): part is 'prompt',
    'chosen' or 'rejected'; place counts the part's turns from 0; start is the offset of the turn
    in the text of its part, in characters; the loss covers loss_length characters from loss_start
    on, the body and end mark of LEARNED_ROLE turns in completions, and nothing elsewhere.

    Turns are ordered by number, then role and text; null numbers come last. Null roles and texts
    render as empty, and equal only each other. A pair with one side missing has an empty prompt;
    one with equal sides has only a prompt. Rows without a pair_id are left out; other columns play
    no part; empty tables give an empty result.
    """
    columns = ("pair_id", "turn", "role", "text")
    first = _placed(chosen.select(*columns).where("pair_id IS NOT NULL"), "pair_id")
    second = _placed(rejected.select(*columns).where("pair_id IS NOT NULL"), "pair_id")
    a = first.select("pair_id", "place", F.struct("role", "text").alias("a"))
    b = second.select("pair_id", "place", F.struct("role", "text").alias("b"))
    # the key has the place too, so the turns of one pair are spread
    both = a.join(b, ["pair_id", "place"], "full")
    equal = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    common = both.groupBy("pair_id").agg(F.min(F.when(~equal, F.col("place"))).alias("differs"))
    # null: no turn differs
    joined = both.join(common, "pair_id")
    shared = F.col("differs").isNull() | (F.col("place") < F.col("differs"))
    sides = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("turn")))).otherwise(
        F.filter(F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("a").alias("turn")),
            F.struct(F.lit("rejected").alias("part"), F.col("b").alias("turn"))), lambda s: s["turn"].isNotNull()))
    rows = joined.select("pair_id", "place", "differs", F.explode(sides).alias("side"))
    header, body = render(F.col("side.turn.role"), F.col("side.turn.text"))
    part = F.col("side.part")
    learned = (part != "prompt") & (F.col("side.turn.role") == LEARNED_ROLE)
    flat = rows.select(
        "pair_id", part.alias("part"), (F.col("place") - F.when(part == "prompt", 0).otherwise(F.col("differs"))).alias("place"),
        F.col("side.turn.role").alias("role"), header.alias("header"), body.alias("body"),
        F.coalesce(learned, F.lit(False)).alias("learned"))
    before = Window.partitionBy("pair_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    length = (F.length("header") + F.length("body")).cast("long")
    return flat.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))).select(
        "pair_id", "part", "place", "role", F.concat("header", "body").alias("rendered"), "start",
        (F.col("start") + F.length("header")).alias("loss_start"),
        F.when(F.col("learned"), F.length("body")).otherwise(F.lit(0)).cast("long").alias("loss_length"))


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from (conv_id, turn, role, text).

    Every conversation is chosen over the turns before its last answer, followed by the last answer of
    the conversation that comes next: the one with the next id that occurs and has an answer, and
    after the last of them the first. Turns are in the order of `format_preferences`. A conversation
    without an answer is rejected as it is, so it only has a prompt. One that is alone with its answer
    has no rejected turn in the place of that answer. Runs a job that reads the answers.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text").where("pair_id IS NOT NULL")
    placed = _placed(turns, "pair_id")
    answered = placed.where(F.col("role") == LEARNED_ROLE)
    # one row per conversation, by ascending id without one global order
    last = answered.groupBy("pair_id").agg(F.max(F.struct("place", "turn", "text")).alias("last"))
    ordered = with_position(last, ["pair_id"], "at", "answers")
    answers = ordered.count()
    before = placed.join(last, "pair_id", "left").where("last IS NULL OR place < last.place").select("pair_id", "turn", "role", "text")
    own = ordered.where(F.lit(answers > 1)).select("pair_id", F.col("last.turn").alias("turn"), F.pmod(F.col("at") + 1, F.lit(max(answers, 1))).alias("at"))
    other = own.join(ordered.select("at", F.col("last.text").alias("text")), "at")
    return turns, before.unionByName(other.select("pair_id", "turn", F.lit(LEARNED_ROLE).alias("role"), "text"))

"""Preference pairs as chat text: a shared prompt and two completions with masks.

Chosen and rejected conversations are compared turn by turn. The longest common prefix of turns is rendered once, as the
prompt; the rest of each is its completion. Masks are spans of characters of a completion that a loss may see: the
texts of the assistant's turns with the mark that ends them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"  # fixed marks of the chat format
LEARNED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _side(turns: DataFrame, own: str) -> DataFrame:
    """Turns of one side with null roles and texts as empty ones; of repeated turns the least (role, text) counts."""
    return (
        turns.filter("pair_id is not null and turn is not null")
        .groupBy("pair_id", "turn")
        .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias(own))
    )


def _completion(turns: Column) -> tuple[Column, Column]:
    """The text of rendered turns and the spans of what is learned, as ``array<struct<from, to>>`` of characters."""
    pieces = F.transform(turns, lambda t: rendered(t["turn"]["role"], t["turn"]["text"]))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        head = F.length(F.lit(OPEN)) + F.length(t["turn"]["role"]) + F.length(F.lit(MIDDLE))
        begin = state["at"] + head
        end = begin + F.length(t["turn"]["text"]) + F.length(F.lit(CLOSE))
        span = F.array(F.struct(begin.cast("long").alias("from"), end.cast("long").alias("to")))
        more = F.when(t["turn"]["role"] == LEARNED, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), more.alias("spans"))

    return F.concat_ws("", pieces), F.aggregate(turns, start, step)["spans"]


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per ``pair_id`` of ``chosen`` and ``rejected``, tables of ``(pair_id, turn, role, text)``.

    Columns: ``pair_id``, ``prompt_turns``, ``prompt``, ``chosen``, ``rejected``, ``chosen_mask``, ``rejected_mask``. Turns are
    compared in the order of ``turn``, which need not be dense. Null roles and texts are empty; turns without a
    pair or a number belong nowhere and are left out. A pair with one side only has an empty completion on the other;
    if one side begins with all of the other, the shorter completion is empty. Other columns are ignored.
    """
    both = _side(chosen, "one").join(_side(rejected, "two"), ["pair_id", "turn"], "full")
    turns = both.groupBy("pair_id").agg(
        F.min(F.when(~F.col("one").eqNullSafe(F.col("two")), F.col("turn"))).alias("parting"),
        F.sort_array(F.collect_list(F.struct("turn", "one", "two"))).alias("turns"),
    )
    shared = F.filter("turns", lambda t: F.col("parting").isNull() | (t["turn"] < F.col("parting")))
    later = lambda side: F.transform(
        F.filter("turns", lambda t: (t["turn"] >= F.col("parting")) & t[side].isNotNull()),
        lambda t: F.struct(t["turn"].alias("at"), t[side].alias("turn")),
    )
    ready = turns.select("pair_id", shared.alias("shared"), later("one").alias("one"), later("two").alias("two"))
    text_one, mask_one = _completion(F.col("one"))
    text_two, mask_two = _completion(F.col("two"))
    prompt = F.concat_ws("", F.transform("shared", lambda t: rendered(t["one"]["role"], t["one"]["text"])))
    return ready.select(
        "pair_id", F.size("shared").alias("prompt_turns"), prompt.alias("prompt"), text_one.alias("chosen"),
        text_two.alias("rejected"), mask_one.alias("chosen_mask"), mask_two.alias("rejected_mask"),
    )


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from conversations alone: the rejected side ends with another conversation's reply.

    The last assistant turn of conversation ``c`` is exchanged for that of ``c + 1``; later turns are left out on the
    rejected side. A conversation whose successor has no reply is paired with its own turns before the reply.
    """
    known = conversations.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    replies = known.filter(F.col("role") == LEARNED).groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("reply")
    )
    chosen = known.withColumnRenamed("conv_id", "pair_id")
    last = replies.select(F.col("conv_id").alias("pair_id"), F.col("reply.turn").alias("last"))
    before = chosen.join(last, "pair_id", "left").filter(F.coalesce(F.col("turn") < F.col("last"), F.lit(True)))
    foreign = (
        replies.select((F.col("conv_id") - 1).alias("pair_id"), F.col("reply.text").alias("text"))
        .join(last, "pair_id")
        .select("pair_id", F.col("last").alias("turn"), F.lit(LEARNED).alias("role"), "text")
    )
    return chosen, before.select("pair_id", "turn", "role", "text").unionByName(foreign)

"""Conversations stored as blocks of messages that turns share.

Every history is a prefix of its conversation. The messages are stored once, in blocks
of bounded size; a turn keeps the number of whole blocks before it and how many
messages of the next one are its own. So what is stored is linear in the turns, however
long a conversation is, no task puts together more than a block, and histories are
made for the turns that need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans import spread

MESSAGES_PER_BLOCK = 64
_TURNS_PER_SEGMENT = 4096


def placed_turns(turns: DataFrame) -> DataFrame:
    """Turns (``conv_id, turn, role, text``) with ``place``: the messages before them. A
    long conversation is spread over tasks; turns of a conversation differ."""
    counted = spread.running_sum(
        turns.select("conv_id", "turn", "role", "text"),
        ["conv_id"],
        spread.by_number(F.col("turn"), _TURNS_PER_SEGMENT),
        ["turn"],
        F.lit(1),
        "_upto",
    )
    return counted.withColumn("place", F.col("_upto") - 1).drop("_upto")


def message_blocks(placed: DataFrame, per_block: int = MESSAGES_PER_BLOCK) -> DataFrame:
    """(conv_id, block, messages): runs of ``per_block`` messages in order, the last one of
    a conversation shorter."""
    block = F.call_function("div", "place", F.lit(per_block)).cast("long")
    rows = placed.withColumn("block", block)
    message = F.struct("place", "role", "text")
    return rows.groupBy("conv_id", "block").agg(
        F.transform(
            F.array_sort(F.collect_list(message)),
            lambda one: F.struct(one["role"].alias("role"), one["text"].alias("text")),
        ).alias("messages")
    )


def turn_places(placed: DataFrame, per_block: int = MESSAGES_PER_BLOCK) -> DataFrame:
    """(conv_id, turn, text, blocks, within) of user turns: whole blocks before the turn,
    and messages of the next block that come before it."""
    return placed.filter(F.col("role") == "user").select(
        "conv_id",
        "turn",
        "text",
        F.call_function("div", "place", F.lit(per_block)).cast("long").alias("blocks"),
        F.pmod("place", F.lit(per_block)).cast("int").alias("within"),
    )


def histories(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, turn, text, history) of the given turns: all messages before each, as
    ``conversations.turn_history`` has them.

    A turn meets its blocks by conversation and number, so turns of one conversation
    spread over tasks too. A history is one result cell.
    """
    last = F.when(F.col("within") > 0, F.col("blocks")).otherwise(F.col("blocks") - 1)
    numbers = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))
    named = places.select("*", F.explode_outer(numbers).alias("block"))
    own = F.when(F.col("block") < F.col("blocks"), F.col("messages")).otherwise(
        F.slice("messages", 1, F.col("within"))
    )
    found = named.join(blocks, ["conv_id", "block"], "left")
    piece = F.when(F.col("messages").isNotNull(), F.struct("block", own.alias("part")))
    return (
        found.groupBy("conv_id", "turn")
        .agg(F.first("text").alias("text"), F.array_sort(F.collect_list(piece)).alias("_parts"))
        .select(
            "conv_id",
            "turn",
            "text",
            F.flatten(F.transform("_parts", lambda one: one["part"])).alias("history"),
        )
    )

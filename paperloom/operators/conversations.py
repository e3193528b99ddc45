"""Chat turns as a table: ``conv_id, turn, role, text``.

``turn`` orders the messages of a conversation and is unique within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions.text import ordered_text
from paperloom.plans import spread

TURNS_PER_SEGMENT = 4096


def _by_turn() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def _before() -> WindowSpec:
    return _by_turn().rowsBetween(Window.unboundedPreceding, -1)


def visible_turns(turns: DataFrame) -> DataFrame:
    """Turns that are shown: all but the system's."""
    return turns.filter(~F.col("role").eqNullSafe(F.lit("system")))


def conversation_sizes(turns: DataFrame, cap: int = fixed.MESSAGE_CAP) -> DataFrame:
    """Messages per conversation and whether no more are taken."""
    return (
        turns.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("messages"))
        .withColumn("at_cap", F.col("messages") >= cap)
    )


def admitted_turns(turns: DataFrame, cap: int = fixed.MESSAGE_CAP) -> DataFrame:
    """Turns a conversation limited to ``cap`` messages takes in.

    The limit is tested before a user's turn, so the user turn that fills the
    conversation still gets its answer: at most ``cap + 1`` turns remain. The
    rank filter runs before the shuffle too, so a conversation of any length
    sends at most ``cap + 1`` rows per task.
    """
    ranked = turns.withColumn("_rank", F.row_number().over(_by_turn())).filter(
        F.col("_rank") <= cap + 1
    )
    answers_last = (F.col("role") == "assistant") & (F.col("_asked") == "user")
    return (
        ranked.withColumn("_asked", F.lag("role").over(_by_turn()))
        .filter((F.col("_rank") <= cap) | answers_last)
        .select(*turns.columns)
    )


def closed_conversations(turns: DataFrame, failed: Column) -> DataFrame:
    """Turns up to and with a conversation's first failed one."""
    counted = spread.running_sum(
        turns.withColumn("_failed", F.coalesce(failed, F.lit(False)).cast("int")),
        ["conv_id"],
        spread.by_number(F.col("turn"), TURNS_PER_SEGMENT),
        ["turn"],
        F.col("_failed"),
        "_failures",
    )
    return counted.filter(F.col("_failures") == F.col("_failed")).select(*turns.columns)


def chat_segments(
    events: DataFrame, user: str, moment: str, reset: Column, order: list[str] | None = None
) -> DataFrame:
    """Number a user's events by conversation: a reset event opens the next one."""
    return spread.running_sum(
        events,
        [user],
        spread.by_hour(F.col(moment)),
        order or [moment],
        F.coalesce(reset, F.lit(False)).cast("int"),
        "segment",
    )


def history_pairs(turns: DataFrame) -> DataFrame:
    """(question, answer) per user turn that the assistant's turn follows directly."""
    shown = visible_turns(turns)
    followed = spread.next_row(
        shown,
        ["conv_id"],
        spread.by_number(F.col("turn"), TURNS_PER_SEGMENT),
        ["turn"],
        ["role", "text"],
        "_next",
    )
    return followed.filter(
        (F.col("role") == "user") & (F.col("_next")["role"] == "assistant")
    ).select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.col("_next")["text"].alias("answer"),
    )


def turn_history(turns: DataFrame) -> DataFrame:
    """Each user turn with all messages before it, in order.

    Put :func:`admitted_turns` in front where conversations are limited.
    """
    message = F.struct("role", "text")
    return (
        turns.withColumn("history", F.collect_list(message).over(_before()))
        .filter(F.col("role") == "user")
        .select("conv_id", "turn", "text", "history")
    )


def paired_history(turns: DataFrame) -> DataFrame:
    """Each user turn with all answered questions before it, as alternating
    ``human`` and ``ai`` messages."""
    following = F.lead(F.struct("role", "text")).over(_by_turn())

    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"))

    pair = F.when(
        (F.col("role") == "user") & (F.col("_next")["role"] == "assistant"),
        F.array(message("human", F.col("text")), message("ai", F.col("_next")["text"])),
    )
    return (
        visible_turns(turns)
        .withColumn("_next", following)
        .withColumn("history", F.flatten(F.collect_list(pair).over(_before())))
        .filter(F.col("role") == "user")
        .select("conv_id", "turn", "text", "history")
    )


def documents_context(documents: DataFrame) -> DataFrame:
    """Per conversation, the texts of its documents (``conv_id, position, text``).

    ``plain`` joins them by blank lines, ``lines`` by line ends, ``numbered``
    labels each with its number.
    """
    items = F.array_sort(F.collect_list(F.struct("position", "text")))
    grouped = documents.groupBy("conv_id").agg(items.alias("_items"))
    texts = F.transform("_items", lambda item: item["text"])
    labelled = F.transform(
        texts,
        lambda text, i: F.concat(
            F.lit(fixed.DOCUMENT_LABEL), (i + 1).cast("string"), F.lit(":\n"), text
        ),
    )
    return grouped.select(
        "conv_id",
        F.size("_items").cast("long").alias("documents"),
        F.array_join(texts, "\n\n").alias("plain"),
        F.array_join(texts, "\n").alias("lines"),
        F.array_join(labelled, "\n\n").alias("numbered"),
    )


def seeded_turns(turns: DataFrame, contexts: DataFrame, seed: tuple[str, str]) -> DataFrame:
    """Open each conversation that has documents with a system turn holding them.

    ``seed`` is the text before and after the documents. Conversations that
    already have a system turn keep it. The added turn is numbered -1.
    """
    started = turns.filter(F.col("role") == "system").select("conv_id").distinct()
    before, after = seed
    opening = contexts.join(started, "conv_id", "left_anti").select(
        "conv_id",
        F.lit(-1).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit("system").alias("role"),
        F.concat(F.lit(before), F.col("plain"), F.lit(after)).alias("text"),
    )
    given = turns.select("conv_id", "turn", "role", "text")
    return given.unionByName(spread.without_partitioning(opening))


def feedback_text(turns: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per conversation: its documents, a blank line, all its messages, one per line."""
    items = F.collect_list(F.struct(F.col("turn").alias("position"), "text"))
    messages = (
        turns.groupBy("conv_id")
        .agg(ordered_text(items, "\n").alias("_messages"))
    )
    return messages.join(contexts.select("conv_id", "lines"), "conv_id", "full_outer").select(
        "conv_id",
        F.concat(
            F.coalesce("lines", F.lit("")), F.lit("\n\n"), F.coalesce("_messages", F.lit(""))
        ).alias("text"),
    )

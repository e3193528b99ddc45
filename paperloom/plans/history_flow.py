"""Stored conversations: message blocks, and turns that name theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import history
from paperloom.sources.tables import table_path

BLOCK_TABLE = "message_block"
PLACE_TABLE = "turn_place"


def store_conversations(
    turns: DataFrame, store: str, per_block: int = history.MESSAGES_PER_BLOCK
) -> None:
    """Write the blocks of all conversations and the places of their user turns."""
    placed = history.placed_turns(turns)
    history.message_blocks(placed, per_block).write.mode("overwrite").parquet(
        table_path(store, BLOCK_TABLE)
    )
    history.turn_places(placed, per_block).write.mode("overwrite").parquet(
        table_path(store, PLACE_TABLE)
    )


def stored_places(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(table_path(store, PLACE_TABLE))


def stored_histories(spark: SparkSession, store: str, places: DataFrame | None = None) -> DataFrame:
    """Histories of the given turns (rows of :func:`stored_places`), or of all."""
    wanted = stored_places(spark, store) if places is None else places
    return history.histories(wanted, spark.read.parquet(table_path(store, BLOCK_TABLE)))

"""Histories from shared blocks against those from the turns."""

import random

from pyspark.sql import functions as F

from paperloom.operators import conversations, history
from paperloom.plans import history_flow

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(frame):
    return sorted((r.conv_id, r.turn, r.text, [tuple(m) for m in r.history]) for r in frame.collect())


def test_histories_equal_those_from_the_turns(spark, tmp_path):
    draw = random.Random(1)
    turns = []
    for conv in range(40):
        at = draw.randrange(3)
        for _ in range(draw.randrange(0, 23)):
            turns.append((conv, at, draw.choice(["user", "assistant", "system"]), f"{conv}.{at}"))
            at += draw.randrange(1, 4)
    turns += [(99, 0, "user", None), (99, 1, "assistant", ""), (99, 5, "user", "last")]
    frame = spark.createDataFrame(turns, SCHEMA).repartition(3)
    want = rows_of(conversations.turn_history(frame))
    for per_block in (1, 4, 64):
        store = str(tmp_path / str(per_block))
        history_flow.store_conversations(frame, store, per_block)
        assert rows_of(history_flow.stored_histories(spark, store)) == want
        some = history_flow.stored_places(spark, store).filter("conv_id = 99 and turn = 5")
        assert rows_of(history_flow.stored_histories(spark, store, some)) == [
            (99, 5, "last", [("user", None), ("assistant", "")])
        ]
    empty = str(tmp_path / "empty")
    history_flow.store_conversations(frame.limit(0), empty)
    assert history_flow.stored_histories(spark, empty).count() == 0


def test_long_conversation_is_stored_once_and_spread(spark, tmp_path):
    count = 50_000
    turns = spark.range(count).select(
        F.lit(7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
    )
    store = str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        history_flow.store_conversations(turns, store)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(f"{store}/{history_flow.BLOCK_TABLE}")
    sizes = blocks.select(F.size("messages").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert sum(r.n for r in sizes) == count and max(r.n for r in sizes) <= history.MESSAGES_PER_BLOCK
    assert len(sizes) == -(-count // history.MESSAGES_PER_BLOCK)
    files = [p for p in (tmp_path / history_flow.BLOCK_TABLE).glob("part-*")]
    assert len(files) > 1  # more than one task wrote the one conversation
    places = history_flow.stored_places(spark, store)
    assert places.count() == count // 2
    wanted = places.filter(F.col("turn").isin(0, 2, 64, 128, 130, 49_998))
    for r in history_flow.stored_histories(spark, store, wanted).collect():
        assert [m.text for m in r.history] == [f"t{i}" for i in range(r.turn)]

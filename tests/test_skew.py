"""A key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import conversations, documents

ROWS = 120_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_thresholds(spark):
    """Sizes at which adaptive execution splits partitions, fit for small tables."""
    changed = {}
    for key, value in SETTINGS.items():
        try:
            changed[key] = spark.conf.get(key)
        except Exception:
            changed[key] = None
        spark.conf.set(key, value)
    yield
    for key, value in changed.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def chunks(spark):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000)
    return spark.range(0, ROWS, 1, 8).select(
        key.alias("document_id"),
        F.concat(F.lit("u"), key.cast("string")).alias("document_uuid"),
        F.col("id").cast("int").alias("chunk_index"),
        F.sha2(F.col("id").cast("string"), 256).alias("chunk_text"),
    )


def share_of_largest_task(frame, is_hot):
    tasks = frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(is_hot).alias("n"))
    counts = [row.n for row in tasks.collect()]
    assert sum(counts) >= ROWS // 3
    return max(counts) / sum(counts)


def test_chunks_of_a_hot_document_are_dealt_out(spark, small_thresholds, chunks):
    table = spark.range(0, 4000).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("document_uuid"),
        F.lit(1).alias("created_at"),
        "id",
    )
    attached = documents.attach_document_ids(chunks.drop("document_id"), table)
    assert attached.count() == chunks.filter(F.col("document_id") < 4000).count()
    assert share_of_largest_task(attached, F.col("document_uuid") == "u0") < 0.4


def test_orphans_of_a_hot_document_are_split(spark, small_thresholds, chunks, plan):
    table = spark.range(1, 4000)
    orphans = documents.orphan_chunks(chunks, table)
    known = chunks.filter(F.col("document_id").between(1, 3999)).count()
    assert len(orphans.collect()) == ROWS - known
    assert "skewed" in plan(orphans)


def test_a_hot_document_sends_one_row_per_task(spark, small_thresholds, chunks, plan):
    table = spark.range(0, 6000)
    unchunked = documents.unchunked_documents(table, chunks)
    assert unchunked.count() == 6000 - chunks.select("document_id").distinct().count()
    assert plan(unchunked).count("HashAggregate") >= 2


def test_a_hot_conversation_is_spread(spark, small_thresholds, monkeypatch):
    monkeypatch.setattr(conversations, "TURNS_PER_SEGMENT", 1000)
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 9000)
    turns = spark.range(0, ROWS, 1, 8).select(
        key.alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    is_hot = F.col("conv_id") == 0
    # A task holds some of the hot conversation's 120 segments.
    closed = conversations.closed_conversations(turns, F.lit(False))
    assert share_of_largest_task(closed, is_hot) < 0.4
    pairs = conversations.history_pairs(turns.withColumn("role", F.when(F.col("turn") % 6 == 0, "user").otherwise("assistant")))
    assert pairs.filter(is_hot).count() == ROWS // 6
    admitted = conversations.admitted_turns(turns)
    assert admitted.filter(is_hot).count() == 20

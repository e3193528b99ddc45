"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A union must not pass on a partitioning its sides share: adaptive execution
    # may read the sides back with different partition counts, and rows of one key
    # would no longer meet. Operators here repartition unions before grouping them;
    # this covers what users add.
    "spark.sql.unionOutputPartitioning": "false",
    # Documents and errors are written in one pass; without this, tasks would first
    # sort the texts by outcome.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Long texts: bound an Arrow batch by its bytes as well as by its rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(
    name: str = "paperloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

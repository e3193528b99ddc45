"""How input is spread over tasks before per-text work."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Input with this many splits per core is spread well enough as it is.
_SPLITS_PER_CORE = 4


def fill_cores(rows: DataFrame) -> DataFrame:
    """Spread an input of few splits, or of fewer files than cores, over all cores.

    A file whose rows are stored as one group is read by one task, however many
    splits it is planned as. Large input has many splits and is left as it is:
    no shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions()
    if splits >= _SPLITS_PER_CORE * cores:
        return rows
    if splits >= cores and len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(cores)

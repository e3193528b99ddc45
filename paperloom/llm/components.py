"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the smallest node of
    the component.

    Alternating star contraction: every node hands its neighbours to the smallest
    of them, first those above it, then those below it, until nothing changes. The
    number of links does not grow; nothing but counts reaches the driver. Minima are
    combined before they are shuffled, and where a hub meets its many links the two
    sides are shuffled as they are, so adaptive execution can split it.
    """
    ends = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).alias("e")
    down = stored(links.filter("a <> b").select(ends).select("e.*").distinct(), "links")
    state = None
    while True:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours of a go to the smallest of a and its neighbours.
        least = _smallest(both).select("a", F.least("a", "m").alias("m"))
        up = both.filter("b > a").repartition("a").join(least.repartition("a"), "a")
        large = up.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = stored(large.distinct(), "links")
        # a and its smaller neighbours go to the smallest of them.
        least = _smallest(large)
        low = large.repartition("a").join(least.repartition("a"), "a")
        small = (
            low.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        down = stored(small, "links")
        now = down.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = down.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    tops = down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(tops)

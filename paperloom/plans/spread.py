"""Running values and joins that survive a hot key.

A window partitioned by the key alone puts all rows of a key into one task. Here
a key's rows are cut into segments along the order column. Windows run per
(key, segment); only one short summary row per segment is ordered per key.

Unions are repartitioned in so many words. Spark may otherwise keep a
partitioning by the key alone that both sides happen to have, which would put a
hot key back into one task, and which does not survive when the sides are read
back with different partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEGMENT = "_segment"
SALTS = 8
_ANY_NUMBER = 1 << 20


def by_number(position: Column, width: int) -> Column:
    """Segment of a numeric position: 0 for the first ``width`` positions and below."""
    return F.greatest(F.call_function("div", position, F.lit(width)), F.lit(0)).cast("long")


def by_hour(moment: Column) -> Column:
    """Segment of a point in time: its hour, for time stamps with or without a zone."""
    return (F.datediff(moment, F.lit("1970-01-01")) * 24 + F.hour(moment)).cast("long")


def running_sum(
    rows: DataFrame,
    keys: list[str],
    segment: Column,
    order: list[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the key's rows up to and including this one.

    ``segment`` must not decrease along ``order`` within a key, and rows with
    equal ``order`` must not exist within a key. The sum up to a segment enters
    it as a row of its own, ahead of the others, so the rows take part in one
    shuffle and no join. Null keys are keys like others.
    """
    placed = rows.withColumns(
        {_SEGMENT: segment, "_value": F.coalesce(value.cast("long"), F.lit(0)), "_real": F.lit(1)}
    )
    earlier = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        placed.groupBy(*keys, _SEGMENT)
        .agg(F.sum("_value").alias("_total"))
        .select(
            *keys,
            _SEGMENT,
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_value"),
            F.lit(0).alias("_real"),
        )
    )
    inside = Window.partitionBy(*keys, _SEGMENT).orderBy("_real", *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        placed.unionByName(before, allowMissingColumns=True)
        .repartition(*keys, _SEGMENT)
        .withColumn(out, F.sum("_value").over(inside))
        .filter(F.col("_real") == 1)
        .select(*rows.columns, out)
    )


def next_row(
    rows: DataFrame,
    keys: list[str],
    segment: Column,
    order: list[str],
    columns: list[str],
    out: str,
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the key's following row, null at its end.

    ``segment`` comes from :func:`by_number`. A segment's first row is put at the
    end of the segment before it too. Keys that end within segment 0, the usual
    case, have no such rows.
    """
    placed = rows.withColumns({_SEGMENT: segment, "_copy": F.lit(0)})
    inside = Window.partitionBy(*keys, _SEGMENT).orderBy(*order)
    firsts = (
        placed.filter(F.col(_SEGMENT) > 0)
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == 1)
        .select(*keys, _SEGMENT, *columns, F.lit(1).alias("_copy"))
    )
    # Per key and segment: the segment itself, then its first row if it is not
    # segment 0. Two rows back from a first row lies the segment before.
    segments = placed.groupBy(*keys, _SEGMENT).agg(F.max("_copy").alias("_copy"))
    along = Window.partitionBy(*keys).orderBy(_SEGMENT, "_copy")
    copies = (
        firsts.unionByName(segments, allowMissingColumns=True)
        .repartition(*keys)
        .withColumn("_previous", F.lag(_SEGMENT, 2).over(along))
        .filter((F.col("_copy") == 1) & F.col("_previous").isNotNull())
        .withColumn(_SEGMENT, F.col("_previous"))
        .drop("_previous")
    )
    following = Window.partitionBy(*keys, _SEGMENT).orderBy("_copy", *order)
    return (
        placed.unionByName(copies, allowMissingColumns=True)
        .repartition(*keys, _SEGMENT)
        .withColumn(out, F.lead(F.struct(*columns)).over(following))
        .filter(F.col("_copy") == 0)
        .select(*rows.columns, out)
    )


def salted_join(
    rows: DataFrame, matches: DataFrame, keys: list[str], deal_by: Column, how: str = "inner"
) -> DataFrame:
    """Join rows, of which a key may have many, with ``matches``, of which it has few.

    A key's rows are dealt over several partitions by ``deal_by``, each with a
    copy of the key's matches. The copies also part the join from an aggregate
    below ``matches``, next to which adaptive execution does not split a
    partition that is still too large.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(deal_by), F.lit(SALTS)).cast("int"))
    copies = matches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def without_partitioning(rows: DataFrame) -> DataFrame:
    """The same rows in the same partitions, of which Spark no longer knows how they
    were made; no shuffle. For unions that are handed out: what groups them later
    then shuffles them."""
    return rows.coalesce(_ANY_NUMBER)

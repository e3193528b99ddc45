"""Hard negatives: rows of another label whose inner product with an anchor lies in a
window below that of a positive.

Vectors are dealt into blocks of bounded size; each block builds one cover tree, which is
stored. Anchors meet the trees in cells (a tree by a slice of the anchors), once for
their positives and once, with the windows that these give, for their negatives. A
cell hands on as many rows for each anchor as are sought; they are ranked in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from paperloom.llm.common import stored
from paperloom.llm.cover_tree import CoverTree, Window


class Plan(NamedTuple):
    """``low`` and ``high``: of a hundred, the shares of a positive's score between which a
    negative's must lie. ``rows`` of a block and ``anchors`` of a slice bound what a
    task holds. ``scale``: a component x becomes floor(scale * x)."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: float = 256.0
    rows: int = 8_192
    anchors: int = 2_048


#: Whole components beyond this are taken as this, so that inner products fit 64 bits.
MOST = 2.0**26
_ANY_SCORE = 2.0**63
_MERGED = 32


def whole_numbers(vectors: list, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), shorter ones filled up with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    return np.clip(np.floor(np.clip(out, -1e300, 1e300) * scale), -MOST, MOST).astype(np.int32)


def _built(rows: DataFrame, plan: Plan) -> DataFrame:
    """Of each partition, which is one block: its tree, and its anchors as rows."""
    schema = pa.schema(
        [
            ("block", pa.int32()),
            ("tree", pa.binary()),
            ("place", pa.int32()),
            ("vec_id", pa.int64()),
            ("label", pa.int64()),
            ("vector", pa.list_(pa.int32())),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch for batch in batches if batch.num_rows]
        if not found:
            return
        whole = pa.Table.from_batches(found)
        vectors = whole_numbers(whole.column("vector").to_pylist(), plan.scale)
        ids = whole.column("vec_id").to_numpy()
        labels = whole.column("label").to_numpy()
        asks = np.flatnonzero(whole.column("asks").to_numpy())
        block = whole.column("block")[0].as_py()
        dumped = CoverTree.build(vectors).dump(ids=ids, labels=labels)
        yield pa.RecordBatch.from_pylist([{"block": block, "tree": dumped}], schema=schema)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(asks), pa.int32()),
                pa.nulls(len(asks), pa.binary()),
                pa.array(asks, pa.int32()),
                pa.array(ids[asks]),
                pa.array(labels[asks]),
                pa.array(list(vectors[asks]), pa.list_(pa.int32())),
            ],
            schema=schema,
        )

    ddl = "block int, tree binary, place int, vec_id long, label long, vector array<int>"
    return rows.withColumn("block", F.spark_partition_id()).mapInArrow(build, ddl)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of a key, by score and then the smaller id, in two steps."""
    order = [F.col("score").desc(), F.col("found_id"), F.col("found_block"), F.col("found_place")]
    some = found.withColumn("part", F.col("found_block") % _MERGED)
    for keys in ([*by, "part"], by):
        rank = F.row_number().over(Over.partitionBy(*keys).orderBy(*order))
        some = some.withColumn("rank", rank).filter(F.col("rank") <= k)
    return some


_FOUND = (
    "block int, place int, nth int, found_id long, found_block int, found_place int, score long"
)


def _searched(trees: DataFrame, anchors: DataFrame, slices: int, negatives: bool, plan: Plan):
    """(block, place, nth, found_id, ..., score): each cell's best rows for its anchors, by
    the anchor's block and place and the number of the window."""
    blocks = trees.select(F.col("block").alias("in_block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    left = trees.select(F.col("block").alias("in_block"), "tree", every)
    dealt = F.pmod(F.xxhash64("block", "place"), F.lit(slices)).cast("int").alias("slice")
    numbers = blocks.agg(F.max("in_block")).first()[0] or 0
    right = anchors.select(
        "*", dealt, F.explode(F.sequence(F.lit(0), F.lit(numbers))).alias("in_block")
    )

    def cell(tree_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree_rows) and len(asked):
            tree, more = CoverTree.load(tree_rows["tree"].iloc[0])
            ids, labels = more["ids"], more["labels"]
            here = int(tree_rows["in_block"].iloc[0])
            width = tree.vectors.shape[1]
            for row in asked.itertuples():
                query = np.zeros(max(width, len(row.vector)), np.int64)
                query[: len(row.vector)] = row.vector
                query = query[:width]
                same = labels == row.label
                if negatives:
                    windows = [
                        Window(-(-plan.low * s // 100), plan.high * s // 100, plan.negatives)
                        for s in (int(x) for x in row.scores)
                    ]
                    allowed = ~same
                else:
                    windows = [Window(-_ANY_SCORE, _ANY_SCORE, plan.positives)]
                    allowed = same
                    if row.block == here:
                        allowed[row.place] = False
                found, _ = tree.search(query, windows, allowed, ids)
                for nth, (points, scores) in enumerate(found):
                    out += [
                        (row.block, row.place, nth, int(ids[p]), here, int(p), int(s))
                        for p, s in zip(points, scores)
                    ]
        names = [part.split()[0] for part in _FOUND.split(", ")]
        return pd.DataFrame(out, columns=names)

    keys = ["in_block", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, _FOUND)


def _usable(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    plan: Plan = Plan(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` picks the anchors among the rows. Scores are inner products of whole
    numbers, floor(scale * x). An anchor's positives are its first other rows of its
    label; for each, the first rows of other labels with a score within the window are
    returned, best first, ties by the smaller id; there may be none.

    Rows of a null id, label or vector, or with a null or non-finite component, take no
    part. Rows that share an id are rows of their own, as anchors too, and may be each
    other's positives. Vectors of different length are filled up with zeros. Whole
    components beyond 2^26 count as 2^26. An empty table gives an empty table.
    """
    label = F.col("label") if label is None else label
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter("vec_id is not null and label is not null and vector is not null")
    rows = rows.filter(_usable(F.col("vector")))
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks = max(-(-total // plan.rows), 2)
    slices = max(-(-asking // plan.anchors), 1)
    made = stored(_built(rows.repartition(blocks), plan), "cover-trees")
    trees = made.filter("tree is not null").select("block", "tree")
    anchors = made.filter("tree is null").drop("tree")

    found = _searched(trees, anchors, slices, False, plan)
    positives = stored(
        _best(found, ["block", "place"], plan.positives).groupBy("block", "place").agg(
            F.array_sort(F.collect_list(F.struct("rank", "found_id", "score"))).alias("positives")
        ),
        "positives",
    )
    windows = anchors.join(positives, ["block", "place"]).withColumn(
        "scores", F.transform("positives", lambda one: one["score"])
    )
    found = _searched(trees, windows.drop("positives"), slices, True, plan)
    ranked = _best(found, ["block", "place", "nth"], plan.negatives)
    named = windows.select(
        "block", "place", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("nth", "one")
    )
    return ranked.join(named, ["block", "place", "nth"]).select(
        "anchor_id",
        F.col("one.found_id").alias("positive_id"),
        "rank",
        F.col("found_id").alias("negative_id"),
        F.col("one.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )

"""Nearest vectors by inner product: collision-counting hashing around the query.

Every vector is projected on single random lines; a line's projections are a sorted
array. A query opens a window around its own projection on every line and counts,
for each vector, on how many lines it lies inside. Windows widen by a factor from
round to round (virtual rehashing: only what they newly cover is counted). A vector
inside on enough lines is verified with the exact inner product. A query ends when
its k best lie within the radius of the round, so that anything nearer would have
been inside as well, with the probability that the threshold was set for.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm of the block, and 0 for the query.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Plan(NamedTuple):
    """``half_width``: half of a window in radii. A vector within the radius is inside it
    with probability 0.76 on each line; ``share`` of the lines are asked for, which
    it misses once in fifteen times, mostly at the edge of the radius. ``first`` is the first radius, as a share of the
    largest distance of a right angle. Blocks bound what a task holds."""

    lines: int = 40
    half_width: float = 1.18
    share: float = 0.66
    first: float = 0.5
    growth: float = 1.12
    vectors: int = 32_768
    queries: int = 512
    seed: int = 5


class Index:
    """Sorted projections of one block of vectors. Rows alike in id and vector are one of
    them, with the number of its ``copies``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plan: Plan, copies: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.plan = ids[order], np.ascontiguousarray(vectors[order]), plan
        self.copies = copies[order]
        squares = (self.vectors**2).sum(axis=1)
        self.most = float(squares.max())
        draw = np.random.default_rng(plan.seed)
        self.lines = draw.standard_normal((vectors.shape[1] + 1, plan.lines))
        rest = np.sqrt(np.maximum(self.most - squares, 0.0))
        projected = self.vectors @ self.lines[:-1] + np.multiply.outer(rest, self.lines[-1])
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def search(self, own_id: int, query: np.ndarray, k: int) -> list[tuple[int, float, int]]:
        """(id, score, copies) of the k nearest found; the query's own row does not count."""
        plan, n = self.plan, len(self.ids)
        left = self.copies.copy()
        same = np.arange(*np.searchsorted(self.ids, [own_id, own_id + 1]))
        left[same[(self.vectors[same] == query).all(axis=1)]] -= 1
        k = min(k, int((left > 0).sum()))
        if k == 0:
            return []
        at = query @ self.lines[:-1]
        asked = int(np.ceil(plan.share * plan.lines))
        square = float((query**2).sum())
        radius = plan.first * np.sqrt(square + self.most)
        middle = [int(np.searchsorted(line, x)) for line, x in zip(self.sorted, at)]
        low, high = middle, middle
        counts = np.zeros(n, np.int64)
        scores = np.full(n, -np.inf)
        done = np.zeros(n, bool)
        best: np.ndarray = np.zeros(0, np.int64)
        while True:
            reach = plan.half_width * radius
            new_low = [
                int(line[:stop].searchsorted(x - reach))
                for line, x, stop in zip(self.sorted, at, low)
            ]
            new_high = [
                start + int(line[start:].searchsorted(x + reach, "right"))
                for line, x, start in zip(self.sorted, at, high)
            ]
            covered = [
                part
                for row, a, b, c, d in zip(self.order, new_low, low, high, new_high)
                for part in (row[a:b], row[c:d])
            ]
            counts += np.bincount(np.concatenate(covered), minlength=n)
            low, high = new_low, new_high
            fresh = np.flatnonzero((counts >= asked) & ~done)
            if len(fresh):
                done[fresh] = True
                fresh = fresh[left[fresh] > 0]
                scores[fresh] = (self.vectors[fresh] * query).sum(axis=1)
                pool = np.concatenate([best, fresh])
                best = pool[np.lexsort((self.ids[pool], -scores[pool]))[:k]]
            if len(best) == k:
                # |q|^2 + M^2 - 2 <q, x> is the square of the distance.
                farthest = square + self.most - 2 * scores[best[-1]]
                if farthest <= radius**2:
                    break
            if done.all():
                break
            radius *= plan.growth
        return [(int(self.ids[i]), float(scores[i]), int(left[i])) for i in best]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    plan: Plan = Plan(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other vectors found, all of
    them if there are fewer, nearest first, ties to the smaller id.

    ``is_query`` picks the queries among the rows. Vectors that are null, zero, empty
    or hold null or non-finite components take no part, nor do rows of a null id.
    Rows that share an id are rows of their own, as queries too; a query's own row alone
    is left out. Rows alike in id and vector are searched once and counted as often as
    they occur. Vectors of different length are not compared. Scores are computed in double precision. An empty table gives
    an empty table.

    Queries meet vectors in cells of bounded size (a block of one by a block of the
    other); a cell hands on k rows a query, which are ranked in two steps.
    """
    named = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    usable = (
        named.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
        .groupBy("vec_id", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.count_if("asks").alias("asking"))
    )
    total, asking = named.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("asks"), F.lit(1)))
    ).first()
    rows, columns = -(-total // plan.vectors) or 1, -(-asking // plan.queries) or 1
    dealt = usable.select(
        "vec_id",
        "vector",
        "copies",
        "asking",
        F.size("vector").alias("length"),
        F.xxhash64("vector").alias("key"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(rows)).cast("int").alias("row"),
        F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), F.lit(columns)).cast("int").alias("column"),
    )
    every_row = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    every_column = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    columns_of = ["length", "row", "column", "vec_id", "key", "vector"]
    stored = dealt.withColumn("column", every_column).select(
        *columns_of, "copies", F.lit(False).alias("asked")
    )
    queries = dealt.filter("asking > 0").withColumn("row", every_row).select(
        *columns_of, F.col("asking").alias("copies"), F.lit(True).alias("asked")
    )

    def cell(members: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked = members["asked"].to_numpy(bool)
        own, queries = members[~asked], members[asked]
        if len(own) and len(queries):
            vectors = np.stack(own["vector"].tolist())
            index = Index(own["vec_id"].to_numpy(), vectors, plan, own["copies"].to_numpy())
            block = int(own["row"].iloc[0])
            for query in queries.itertuples():
                found = index.search(query.vec_id, np.asarray(query.vector), k)
                out += [
                    (query.vec_id, query.key, query.copies, block, i, score, min(n, k))
                    for i, score, n in found
                ]
        names = ["query_id", "key", "times", "row", "vec_id", "score", "copies"]
        return pd.DataFrame(out, columns=names)

    found = (
        stored.unionByName(queries)
        .groupBy("length", "row", "column")
        .applyInPandas(
            cell,
            "query_id long, key long, times long, row int, vec_id long, score double, copies int",
        )
    )

    def repeated(frame: DataFrame, count: str) -> DataFrame:
        one = F.sequence(F.lit(1), F.col(count).cast("int"))
        return frame.withColumn(count, F.explode(one))

    order = [F.col("score").desc(), F.col("vec_id")]
    some = repeated(found, "copies").withColumn("part", F.col("row") % int(np.ceil(np.sqrt(rows))))
    for by in (["query_id", "key", "part"], ["query_id", "key"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        some = some.withColumn("rank", place).filter(F.col("rank") <= k)
    return repeated(some, "times").select("query_id", "rank", "vec_id", "score")

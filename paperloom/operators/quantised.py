"""Similarity search over quantised vectors in cells.

A vector's direction is its cell's centre plus a residual. The residual is cut into short
parts, and each part is replaced by the number of the nearest entry of that part's code
book: a byte for two values. A table looked up by these bytes gives a direction close to
the vector's, and what the two differ by, which is known when the vector is encoded, bounds
how far a similarity can be off.

* The approximate search looks up the codes of the cells a question probes and compares
  its best few vectors exactly.
* The exact search leaves out cells and vectors that the bounds show cannot win: by the
  triangle inequality no vector of a cell is closer to a question than the centre less
  the cell's widest angle, and none is closer than its code by more than its error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed_values as fixed
from paperloom.operators.embedding import as_matrix
from paperloom.operators.retrieval import QUESTION_BYTES, nearest_cells, one_array

# Vectors the quantiser is fitted on, drawn by a hash of their keys.
TRAINED_ON = 16_384
ENTRIES = 256
# What is held of a matrix of scores.
_SCORES_PER_BLOCK = 2_000_000
_SCORE_DIGITS = 12
# Similarities are first taken in single precision.
_SLACK = 2e-6
_MERGE_PARTS = 32
# Candidates of all questions of a task or cell, as many as a question may keep.
KEPT_ROWS = 500_000
# Codes in one cell of the grid that many questions need, and cells for each core, at least.
CODES_PER_CELL = 200_000
_CELLS_PER_CORE = 4
_SPREAD = 2
_MOST_PARTITIONS = 4096


class Quantiser(NamedTuple):
    """``centres``: unit vectors, one a cell. ``books``: for each part of a vector, its
    first place and its entries."""

    centres: np.ndarray
    books: list[tuple[int, np.ndarray]]

    def directions(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        found = self.centres[cells]
        for part, (start, entries) in enumerate(self.books):
            found[:, start : start + entries.shape[1]] += entries[codes[:, part]]
        return found

    def encode(self, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, codes) of unit vectors."""
        cells = nearest_cells(directions, self.centres, 1)[:, 0]
        rest = directions - self.centres[cells]
        codes = np.empty((len(directions), len(self.books)), np.uint8)
        for part, (start, entries) in enumerate(self.books):
            codes[:, part] = _nearest(rest[:, start : start + entries.shape[1]], entries)
        return cells, codes


def _nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    half = (entries * entries).sum(axis=1) / 2
    step = max(_SCORES_PER_BLOCK // len(entries), 1)
    for at in range(0, len(rows), step):
        out[at : at + step] = np.argmax(rows[at : at + step] @ entries.T - half, axis=1)
    return out


def _means(rows: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm on rows that fit in memory; a mean without rows keeps its place."""
    draw = np.random.default_rng(seed)
    means = rows[draw.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        owner = _nearest(rows, means)
        sums = np.zeros_like(means)
        np.add.at(sums, owner, rows)
        size = np.bincount(owner, minlength=len(means))
        means[size > 0] = sums[size > 0] / size[size > 0, None]
    return means


def _units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.exists(vector, lambda value: value != 0)


def train(
    chunks: DataFrame,
    cells: int,
    parts: int | None = None,
    sample: int = TRAINED_ON,
    rounds: int = 10,
    seed: int = 7,
) -> Quantiser:
    """Fit cells and code books on about ``sample`` of the vectors. ``parts`` of a vector
    have a byte each; two values a part if it is not given. Cells are fitted on the driver
    on that sample, code books in tasks, one part in one task."""
    usable = chunks.filter(_usable(F.col("embedding")))
    total = max(usable.count(), 1)
    key = F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(1 << 30))
    some = usable.filter(key < math.ceil((1 << 30) * min(sample / total, 1)))
    column = some.orderBy("document_id", "chunk_index").select("embedding").toArrow().column(0)
    vectors = np.vstack([as_matrix(part) for part in column.chunks if len(part)] or [np.zeros((0, 1))])
    if not len(vectors):
        raise ValueError("there is no vector to fit on")
    units = _units(vectors.astype(np.float64))
    means = _units(_means(units, cells, rounds, seed))
    rest = units - means[nearest_cells(units, means, 1)[:, 0]]
    places = np.array_split(np.arange(units.shape[1]), min(parts or -(-units.shape[1] // 2), units.shape[1]))
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(rest)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["id"]:
                own = np.ascontiguousarray(sent.value[:, places[part]])
                entries = _means(own, ENTRIES, rounds, seed)
                yield pd.DataFrame({"part": [part], "entries": [entries.ravel().tolist()]})

    numbers = spark.range(len(places)).repartition(len(places))
    fitted = numbers.mapInPandas(fit, "part long, entries array<double>").collect()
    books: list[tuple[int, np.ndarray]] = [(0, np.zeros((0, 0)))] * len(places)
    for part, entries in fitted:
        width = len(places[part])
        books[part] = (int(places[part][0]), np.array(entries).reshape(-1, width))
    return Quantiser(means, books)


INDEX_COLUMNS = "cell int, angle double, error double, codes binary"


def encode(chunks: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(document_id, chunk_index, embedding, cell, angle, error, codes) of every vector
    that is not null or of length zero: such match nothing. ``angle`` is that to the
    centre, ``error`` the distance of the direction from what its code stands for. No
    shuffle. Written with ``partitionBy("cell")`` it is the index."""
    sent = chunks.sparkSession.sparkContext.broadcast(quantiser)
    rows = chunks.filter(_usable(F.col("embedding"))).select(
        F.col("document_id").cast("long").alias("document_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "embedding",
    )
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(INDEX_COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = sent.value
            units = _units(as_matrix(batch.column("embedding"), model.centres.shape[1]).astype(float))
            cells, codes = model.encode(units)
            near = (units * model.centres[cells]).sum(axis=1)
            error = np.linalg.norm(units - model.directions(cells, codes), axis=1)
            columns = [
                *batch.columns,
                pa.array(cells.astype(np.int32)),
                pa.array(np.arccos(np.clip(near, -1, 1))),
                pa.array(error),
                pa.array([row.tobytes() for row in codes], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[field.name for field in schema])

    return rows.mapInArrow(run, schema)


def approximate_top_k(
    questions: DataFrame,
    index: DataFrame,
    quantiser: Quantiser,
    probes: int,
    k: int = fixed.TOP_K,
    keep: int | None = None,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """(query_id, rank, document_id, chunk_index, score): the k best of the ``keep`` vectors
    whose codes come closest to a question, in its ``probes`` nearest cells.

    Of the index the probed cells' codes are read, and the vectors of the kept ones. Scores
    are exact, rounded and ordered as in the search that compares everything.
    """
    keep = max(keep or 12 * k, k)
    found = _near_codes(questions, index, quantiser, probes, keep, question_bytes)
    kept = _first(found, keep, "near")
    vectors = index.select("document_id", "chunk_index", F.col("embedding").alias("_vector"))
    asked = questions.select("query_id", F.col("embedding").alias("_question"))
    # Vectors of the same key come back together, whichever of them were kept.
    pairs = kept.select("query_id", "document_id", "chunk_index").distinct().join(
        vectors, ["document_id", "chunk_index"]
    )
    scored = pairs.join(asked, "query_id").withColumn(
        "score", _cosine(F.col("_question"), F.col("_vector"))
    )
    return _first(scored.drop("_vector", "_question"), k, "score")


def exact_top_k(
    questions: DataFrame,
    index: DataFrame,
    quantiser: Quantiser,
    k: int = fixed.TOP_K,
    seeds: int = 2,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """The rows of ``retrieval.top_k_chunks``, without comparing what cannot win.

    The k-th best of a question's ``seeds`` nearest cells is a floor. Cells and then
    vectors whose bound lies below it are left out; the rest are compared exactly.
    """
    found = _bounded(questions, index, quantiser, k, seeds, question_bytes, counted=False)
    return _first(found, k, "score")


def compared(
    questions: DataFrame,
    index: DataFrame,
    quantiser: Quantiser,
    k: int = fixed.TOP_K,
    seeds: int = 2,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """(query_id, looked_up, compared): of how many vectors the exact search looks at the
    code and at the vector, after its floors are known."""
    found = _bounded(questions, index, quantiser, k, seeds, question_bytes, counted=True)
    sums = [F.sum(name).alias(name) for name in ("looked_up", "compared")]
    return found.groupBy("query_id").agg(*sums)


def cell_angles(index: DataFrame) -> dict[int, float]:
    """The widest angle in each cell that has vectors: one number a cell."""
    rows = index.groupBy("cell").agg(F.max("angle").alias("angle")).collect()
    return {row["cell"]: row["angle"] for row in rows}


class _Asked(NamedTuple):
    ids: pa.Array
    vectors: np.ndarray
    floors: np.ndarray
    cells: np.ndarray  # question x cell: whether it is looked at

    def units(self) -> np.ndarray:
        return _units(self.vectors)


def _usable_questions(questions: DataFrame, keep: int, question_bytes: int):
    """Usable questions, how many, and the columns they are dealt into: none, while their
    vectors and what they keep may be held by every task."""
    usable = questions.filter(_usable(F.col("embedding")))
    count, values = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    parts = max(count * 8 * (values or 1) / question_bytes, count * keep / KEPT_ROWS)
    return usable, count, math.ceil(parts) if parts > 1 else 0


class _Near(NamedTuple):
    """Each question looks at its ``probes`` nearest cells."""

    probes: int

    def __call__(self, vectors: np.ndarray, floors: np.ndarray, centres: np.ndarray) -> np.ndarray:
        cells = np.zeros((len(vectors), len(centres)), bool)
        near = nearest_cells(vectors, centres, self.probes)
        cells[np.arange(len(vectors))[:, None], near] = True
        return cells


class _Reached(NamedTuple):
    """Each question looks at the cells whose widest angle lets them reach its floor."""

    widest: np.ndarray

    def __call__(self, vectors: np.ndarray, floors: np.ndarray, centres: np.ndarray) -> np.ndarray:
        apart = np.arccos(np.clip(_units(vectors.astype(float)) @ centres.T, -1, 1))
        most = np.cos(np.maximum(apart - self.widest, 0))
        return (self.widest >= 0) & (most >= floors[:, None] - _SLACK)


def _asked(table: pa.Table, quantiser: Quantiser, choose: _Near | _Reached) -> _Asked:
    width = quantiser.centres.shape[1]
    ids, floors = (one_array(table.column(name)) for name in ("query_id", "floor"))
    floors = floors.to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = as_matrix(one_array(table.column("embedding")), width).astype(np.float64)
    return _Asked(ids, vectors, floors, choose(vectors, floors, quantiser.centres))


def _near_codes(
    questions: DataFrame,
    index: DataFrame,
    quantiser: Quantiser,
    probes: int,
    keep: int,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """(query_id, document_id, chunk_index, near): each task's or cell's ``keep`` best by code."""
    usable, count, columns = _usable_questions(questions, keep, question_bytes)
    rows = usable.select("query_id", "embedding", F.lit(-math.inf).alias("floor"))
    read = index.select("cell", "document_id", "chunk_index", "codes")
    return _scanned(read, rows, quantiser, _Near(probes), keep, "near", count, columns)


def _bounded(questions, index, quantiser, k, seeds, question_bytes, counted) -> DataFrame:
    widest = np.full(len(quantiser.centres), -1.0)
    for cell, angle in cell_angles(index).items():
        widest[cell] = angle
    usable, count, columns = _usable_questions(questions, k, question_bytes)
    best = approximate_top_k(usable, index, quantiser, seeds, k, 4 * k, question_bytes)
    floors = best.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor")
    )
    rows = usable.select("query_id", "embedding").join(floors, "query_id", "left")
    # Spark and tasks may round a score to neighbouring last digits.
    low = F.col("floor") - 10 * 10**-_SCORE_DIGITS
    rows = rows.withColumn("floor", F.coalesce(low, F.lit(-math.inf)))
    read = index.select("cell", "document_id", "chunk_index", "codes", "error", "embedding")
    what = "count" if counted else "score"
    return _scanned(read, rows, quantiser, _Reached(widest), k, what, count, columns)


def _first(found: DataFrame, k: int, by: str) -> DataFrame:
    """The first k of a question, in two steps."""
    order = [F.col(by).desc(), "document_id", "chunk_index"]
    part = F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(_MERGE_PARTS))
    some = found.withColumn("_part", part)
    for keys in (["query_id", "_part"], ["query_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        some = some.withColumn("rank", rank).filter(F.col("rank") <= k)
    return some.select("query_id", "rank", "document_id", "chunk_index", by)


def _cosine(left: Column, right: Column) -> Column:
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)

    return F.round(dot(left, right) / F.sqrt(dot(left, left) * dot(right, right)), _SCORE_DIGITS)


def _scanned(
    index: DataFrame,
    questions: DataFrame,
    quantiser: Quantiser,
    choose: _Near | _Reached,
    k: int,
    what: str,
    count: int,
    columns: int,
) -> DataFrame:
    """The codes of the cells that any question looks at, each passed by every question.
    ``what``: "near", the k best by code; "score", the k best by vector among those whose
    bound reaches the floor; "count", how many these are.

    Few questions are sent to every task, and the files of other cells are not read. Many
    meet the codes in a grid of bounded cells and are never on the driver.
    """
    context = index.sparkSession.sparkContext
    fields = [T.StructField("query_id", questions.schema["query_id"].dataType)]
    if what == "count":
        fields += [T.StructField(n, T.LongType()) for n in ("looked_up", "compared")]
    else:
        fields += [T.StructField(n, T.LongType()) for n in ("document_id", "chunk_index")]
        fields.append(T.StructField(what, T.DoubleType()))
    schema = T.StructType(fields)

    if not columns:
        asked = _asked(questions.toArrow(), quantiser, choose)
        wanted = np.flatnonzero(asked.cells.any(axis=0)).tolist()
        sent = context.broadcast((asked, quantiser))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = _Scan(*sent.value, k, what)
            for batch in batches:
                scan.add(batch)
            yield from scan.done()

        return index.filter(F.col("cell").isin(wanted)).mapInArrow(run, schema)

    held = index.count()
    cells = _CELLS_PER_CORE * context.defaultParallelism
    columns = max(columns, min(math.ceil(math.sqrt(cells * count / max(held, 1))), count))
    rows = max(math.ceil(held / CODES_PER_CELL), min(math.ceil(cells / columns), held), 1)
    model = context.broadcast(quantiser)

    def meet(codes: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if codes.num_rows and asking.num_rows:
            scan = _Scan(_asked(asking, model.value, choose), model.value, k, what)
            for batch in codes.to_batches():
                scan.add(batch)
            found = list(scan.done())
        ids = asking.schema.field("query_id").type
        rest = [pa.float64() if field.name == what else pa.int64() for field in fields[1:]]
        kinds = zip(schema.names, [ids, *rest])
        return pa.Table.from_batches(found, schema=pa.schema(list(kinds)))

    def dealt(side: DataFrame, keys: list[str], own: str, parts: int, other: str, others: int):
        place = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        placed = side.select("*", place, every)
        partitions = min(_SPREAD * rows * columns, _MOST_PARTITIONS)
        return placed.repartition(partitions, "_row", "_column").groupBy("_row", "_column")

    left = dealt(index, ["document_id", "chunk_index"], "_row", rows, "_column", columns)
    right = dealt(questions, ["query_id"], "_column", columns, "_row", rows)
    return left.cogroup(right).applyInArrow(meet, schema)


class _Scan:
    """What one task keeps: for each question the k best so far, and a floor."""

    def __init__(self, asked: _Asked, quantiser: Quantiser, k: int, what: str):
        self.asked, self.quantiser, self.k, self.what = asked, quantiser, k, what
        self.units = asked.units()
        self.narrow = self.units.astype(np.float32)
        self.floors = asked.floors.copy()
        self.counts = np.zeros((2, len(self.floors)), np.int64)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        cells = batch.column("cell").to_numpy()
        parts = len(self.quantiser.books)
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
        keys = [batch.column(n).to_numpy() for n in ("document_id", "chunk_index")]
        if self.what != "near":
            error = batch.column("error").to_numpy()
            vectors = as_matrix(batch.column("embedding")).astype(np.float64)
            lengths = (vectors * vectors).sum(axis=1)
        for cell in np.unique(cells):
            rows = np.flatnonzero(cells == cell)
            active = np.flatnonzero(self.asked.cells[:, cell])
            step = max(_SCORES_PER_BLOCK // max(len(active), 1), 1)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                about = self.quantiser.directions(cells[some], codes[some]).astype(np.float32)
                near = self.narrow[active] @ about.T
                if self.what == "near":
                    self._near(active, some, near, keys)
                    continue
                reach = near + (error[some] + _SLACK).astype(np.float32)
                question, row = np.nonzero(reach >= self.floors[active, None].astype(np.float32) - _SLACK)
                question, row = active[question], some[row]
                self.counts[0, active] += len(some)
                self.counts[1] += np.bincount(question, minlength=len(self.floors))
                if self.what == "score":
                    for a in range(0, len(row), 200_000):
                        self._exact(question[a : a + 200_000], row[a : a + 200_000], vectors, lengths, keys)

    def _near(self, active, rows, near, keys) -> None:
        least = self.floors[active].astype(np.float32)
        # Of questions that have no floor yet, the k best of this block.
        new = np.flatnonzero(np.isneginf(least))
        if len(rows) > self.k and len(new):
            kth = np.partition(near[new], len(rows) - self.k, axis=1)[:, len(rows) - self.k]
            least[new] = kth
        question, row = np.nonzero(near >= least[:, None])
        self._keep(active[question], near[question, row].astype(float), [x[rows[row]] for x in keys])

    def _exact(self, question, row, vectors, lengths, keys) -> None:
        own = self.asked.vectors[question]
        products = (own * vectors[row]).sum(axis=1)
        score = np.round(products / np.sqrt((own * own).sum(axis=1) * lengths[row]), _SCORE_DIGITS)
        good = score >= self.floors[question]
        self._keep(question[good], score[good], [x[row[good]] for x in keys])

    def _keep(self, question, score, keys) -> None:
        self.kept.append((question, score, *keys))
        self.size += len(question)
        if self.size > 2 * self.k * len(self.floors) + 100_000:
            self._shrink()

    def _shrink(self) -> None:
        question, score, *keys = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((keys[1], keys[0], -score, question))
        question, score, keys = question[order], score[order], [x[order] for x in keys]
        starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        rank = np.arange(len(question)) - np.repeat(starts, np.diff(np.r_[starts, len(question)]))
        last = rank == self.k - 1
        self.floors[question[last]] = np.maximum(self.floors[question[last]], score[last])
        good = rank < self.k
        self.kept = [(question[good], score[good], *[x[good] for x in keys])]
        self.size = int(good.sum())

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.what == "count":
            used = np.flatnonzero(self.counts.any(axis=0))
            ids = self.asked.ids.take(pa.array(used))
            columns = [ids, *(pa.array(x[used]) for x in self.counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "looked_up", "compared"])
        elif self.size:
            self._shrink()
            question, score, document, chunk = self.kept[0]
            columns = [self.asked.ids.take(pa.array(question)), pa.array(document), pa.array(chunk), pa.array(score)]
            names = ["query_id", "document_id", "chunk_index", self.what]
            yield pa.RecordBatch.from_arrays(columns, names=names)

"""The chunks most similar to each of many questions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed_values as fixed
from paperloom.operators.embedding import (
    Embedder,
    as_matrix,
    embed_packed,
    packed_width,
    unpacked_vectors,
)

# Largest question matrix that is sent to every task. A cell of the grid used
# beyond that holds twice as much on average.
QUESTION_BYTES = 32 * 1024 * 1024
# Chunks in one cell of that grid, and pairs that a cell compares on average.
CHUNKS_PER_CELL = 100_000
PAIRS_PER_CELL = 8_000_000_000
# Chunks whose vectors, a byte for each value, take as much as one in single precision.
_WHOLE_VECTORS = 4
# Ranked rows (ids, a rank and a score) that are sent to every task.
RANKED_SENT = 200_000
# Largest matrix of cell centres that is sent to every task.
CENTRE_BYTES = 64 * 1024 * 1024
# Steps in which the candidates of a question are merged: parts of it, then it.
_MERGE_PARTS = 32
# Candidates of a question that one step merges.
_MERGED_AT_ONCE = 4096
# Cells of a grid for each core, at least.
_CELLS_PER_CORE = 4
# Partitions of a grid for each of its cells, so that few cells share one, and at most.
_SPREAD = 2
_MOST_PARTITIONS = 4096
# Cells that are dealt to partitions one by one, at most.
_CELLS_DEALT = 2048
# Pairs scored at a time, which bounds the score matrix, and questions among them.
_SCORES_PER_BLOCK = 1_048_576
_QUESTIONS_PER_BLOCK = 1024
# Products of counts that are worked out at once: the bound that they stay below, how many
# share a number, the numbers' kinds, and the kind of a share, of which a number has one more,
# if there is one.
_SHARES = 3
_SHARED = (
    (1 << 8, 3, np.float32, np.int32, np.uint8),
    (1 << 12, 2, np.float32, np.int32, None),
    (1 << 16, 3, np.float64, np.int64, np.uint16),
)
# Questions and numbers of such a product, numbers of three with one threshold, and values of a
# block.
_COUNTED_QUESTIONS = 512
_NUMBERS_PER_TILE = 512
_NUMBERS_TOGETHER = 16
_COUNTED_VALUES = 3_145_728
# Chunks of the first block, and how many times those seen so far the next ones have at most.
_FIRST_CHUNKS = 256
_GROWTH = 3
# More than rounding can change a score.
_SCORE_SLACK = 1e-9
# Vectors that are in double precision at a time while lengths are worked out.
_SQUARED_AT_ONCE = 1024
# Values of the vectors that are compared in double precision at a time.
_EXACT_VALUES = 131_072
_SCORE_DIGITS = 12


def top_k_chunks(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.TOP_K,
    min_score: float | None = None,
    embedder: Embedder | None = None,
    carry: tuple[str, ...] = (),
    question_bytes: int = QUESTION_BYTES,
    held: Callable[[], int] | None = None,
) -> DataFrame:
    """Exact k best chunks per question by cosine.

    ``questions``: ``query_id`` (any type) and ``embedding``, or ``packed``, the same as bytes
    (:func:`paperloom.operators.embedding.embed_packed`). ``chunks``: ``document_id,
    chunk_index`` and either ``embedding`` or, with an ``embedder``,
    ``chunk_text`` to embed on the way. Returns ``query_id, rank, document_id,
    chunk_index, score`` and the ``carry`` columns. Scores have 12 digits; equal
    ones go by document and index. Only scores above ``min_score`` count; vectors
    of length zero match nothing.

    The questions' matrix is measured. Up to ``question_bytes`` it is sent to
    every task, which multiplies it with its blocks of chunks and keeps k per
    question: chunks are not shuffled. Beyond, questions and chunks are hashed
    into a grid of bounded cells, with partitions enough for a task to have few.
    Either way pairs exist only as numbers within a block, and each task or cell
    passes on k per question. Pairs are compared in single precision; those that
    can be among the best, with its error, are compared again in double precision.
    ``held`` gives the number of chunks where counting them means making them.
    """
    ranker = _Ranker(questions, chunks, k, min_score, embedder, carry)
    count, width = _measure(questions)
    row_bytes = 8 * max(width, 1)
    if count * row_bytes <= question_bytes:
        return ranker.ranked(ranker.broadcast_candidates())
    columns = math.ceil(count * row_bytes / question_bytes / 2)
    return ranker.grid_ranked(count, held() if held else chunks.count(), columns)


def approximate_top_k(
    questions: DataFrame,
    cells: DataFrame,
    centres: np.ndarray,
    probes: int,
    k: int = fixed.TOP_K,
    min_score: float | None = None,
    chunks_per_block: int = CHUNKS_PER_CELL,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """Like :func:`top_k_chunks`, comparing each question with the chunks of its
    ``probes`` nearest cells only. ``cells`` are chunks from :func:`assign_cells`.

    Tasks find the cells of their questions. Questions and chunks of a cell meet in
    blocks bounded in chunks, questions and bytes, so neither a cell nor the questions
    that probe it are ever gathered. Stored by cell, cells no question probes are not read. What the
    driver sees are two counts a cell; the centres are checked before they are sent.
    """
    ranker = _Ranker(questions, cells, k, min_score, None, ())
    asked = probed_cells(questions.select("query_id", "embedding"), centres, probes)
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells")
    wanted = {row["cell"]: row["count"] for row in asked.groupBy("cell").count().collect()}
    reachable = cells.filter(F.col("cell").isin(list(wanted)))
    held = {row["cell"]: row["count"] for row in reachable.groupBy("cell").count().collect()}
    per_block = max(question_bytes // (8 * centres.shape[1]), 1)
    # Wide vectors: fewer chunks, as many bytes.
    chunks_per_block = min(chunks_per_block, max(question_bytes // (4 * centres.shape[1]), 1))
    grid = [
        (cell, math.ceil(count / chunks_per_block), math.ceil(wanted[cell] / per_block))
        for cell, count in held.items()
    ]
    sizes = F.broadcast(
        questions.sparkSession.createDataFrame(grid, "cell int, _rows int, _columns int")
    )

    def dealt(rows: DataFrame, keys: list[str], own: str, own_parts: str, other: str, others: str):
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        placed = rows.join(sizes, "cell").withColumn(
            own, F.pmod(F.xxhash64(*keys), F.col(own_parts)).cast("int")
        )
        return placed.withColumn(other, every).drop("_rows", "_columns")

    keys = ["document_id", "chunk_index"]
    left = dealt(ranker.inputs(reachable, "cell"), keys, "_row", "_rows", "_column", "_columns")
    right = dealt(asked, ["query_id"], "_column", "_columns", "_row", "_rows")
    blocks = sum(rows * columns for _, rows, columns in grid)
    met = ranker.cell_candidates(left, right, ["cell", "_row", "_column"], blocks)
    # A question meets the blocks of one column in each cell that it probes.
    most = probes * max((rows for _, rows, _ in grid), default=1)
    return ranker.ranked(met, most * k)


def probed_cells(questions: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Add ``cells``: the numbers of the ``probes`` centres nearest to the vector."""
    return _with_cells(questions.filter(F.col("embedding").isNotNull()), centres, probes, "cells")


def mean_centres(chunks: DataFrame, group: str) -> np.ndarray:
    """One centre for each value of ``group``, in its order: the mean of its vectors.

    Means are sums by (group, place), combined before they are shuffled."""
    entries = chunks.filter("embedding is not null").select(
        group, F.posexplode("embedding").alias("_at", "_value")
    )
    means = entries.groupBy(group, "_at").agg(F.avg(F.col("_value").cast("double")).alias("_mean"))
    rows = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", "_mean"))).alias("m"))
    return np.array([[x["_mean"] for x in row["m"]] for row in rows.orderBy(group).collect()])


def train_cells(
    chunks: DataFrame, cells: int, iterations: int = 10, seed: int = 7
) -> np.ndarray:
    """Centres of ``cells`` cells, by k-means over the directions of all chunks."""
    usable = chunks.select(array_to_vector("embedding").alias("features")).filter(
        F.exists("embedding", lambda value: value != 0)
    )
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=iterations, seed=seed).fit(usable)
    return np.array(model.clusterCenters())


def assign_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``cell``: the centre closest in direction to the chunk's vector.

    Written with ``partitionBy("cell")``, this is the index for
    :func:`approximate_top_k`. No shuffle.
    """
    found = _with_cells(chunks, centres, 1, "_cells")
    return found.withColumn("cell", F.col("_cells")[0]).drop("_cells")


def _with_cells(rows: DataFrame, centres: np.ndarray, probes: int, name: str) -> DataFrame:
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"centres take {centres.nbytes} bytes; {CENTRE_BYTES} may be sent")
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = as_matrix(batch.column("embedding"), shared.value.shape[1])
            found = nearest_cells(vectors, shared.value, probes).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(found.reshape(-1), found.shape[1])
            names = [*batch.schema.names, name]
            columns = [*batch.columns, lists.cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(locate, schema)


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Per vector, the cells whose centres are closest to it in direction."""
    directions = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    probes = min(probes, len(directions))
    chosen = np.empty((len(vectors), probes), dtype=np.int64)
    rows_at_once = max(_SCORES_PER_BLOCK // len(directions), 1)
    for start in range(0, len(vectors), rows_at_once):
        block = vectors[start : start + rows_at_once]
        lengths = np.linalg.norm(block, axis=1, keepdims=True)
        closeness = np.round(block @ directions.T / np.maximum(lengths, 1e-300), _SCORE_DIGITS)
        nearest = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
        chosen[start : start + rows_at_once] = nearest
    return chosen


class _Ranker:
    """Candidate search for one call: which columns come in, what goes out."""

    def __init__(
        self,
        questions: DataFrame,
        chunks: DataFrame,
        k: int,
        min_score: float | None,
        embedder: Embedder | None,
        carry: tuple[str, ...],
    ) -> None:
        self.questions = questions
        self.chunks = chunks
        self.k = k
        self.min_score = -math.inf if min_score is None else min_score
        self.embedder = embedder
        self.carry = list(carry)
        fields = [
            T.StructField("query_id", questions.schema["query_id"].dataType),
            T.StructField("document_id", T.LongType()),
            T.StructField("chunk_index", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
        self.schema = T.StructType([*fields, *[chunks.schema[name] for name in self.carry]])

    def ranked(self, candidates: DataFrame, most: int | None = None) -> DataFrame:
        """``most``: candidates that a question can have, if that is known."""
        best_first = Window.partitionBy("query_id").orderBy(
            F.col("score").desc(), "document_id", "chunk_index"
        )
        part = _hash_part(["document_id", "chunk_index"], _MERGE_PARTS)
        of_part = Window.partitionBy("query_id", "_part").orderBy(
            F.col("score").desc(), "document_id", "chunk_index"
        )
        if most is None or most > _MERGED_AT_ONCE:
            ranks = F.row_number().over(of_part)
            candidates = candidates.withColumn("_part", part).withColumn("_rank", ranks)
            candidates = candidates.filter(F.col("_rank") <= self.k)
        return (
            candidates.withColumn("rank", F.row_number().over(best_first))
            .filter(F.col("rank") <= self.k)
            .select("query_id", "rank", "document_id", "chunk_index", "score", *self.carry)
        )

    def inputs(self, chunks: DataFrame, *extra: str) -> DataFrame:
        vector = "chunk_text" if self.embedder else "embedding"
        usable = chunks if self.embedder else chunks.filter(F.col("embedding").isNotNull())
        return usable.select(
            F.col("document_id").cast("long").alias("document_id"),
            F.col("chunk_index").cast("long").alias("chunk_index"),
            *dict.fromkeys([vector, *self.carry, *extra]),
        )

    def broadcast_candidates(self) -> DataFrame:
        shared = self.questions.sparkSession.sparkContext.broadcast(
            _collect_questions(self.questions)
        )
        search = _Search(self.k, self.min_score, self.embedder, self.carry)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from search.task(*shared.value, batches)

        return self.inputs(self.chunks).mapInArrow(run, self.schema)

    def grid_ranked(self, count: int, held: int, columns: int) -> DataFrame:
        rows, columns = self._grid(count, held, columns)
        question_cells = self.questions.select(
            "query_id",
            _vector_column(self.questions),
            _hash_part(["query_id"], columns).alias("_column"),
            F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_row"),
        )
        inputs = self.inputs(self.chunks)
        if self.embedder:
            # Once for each chunk; what meets the columns of questions are vectors.
            inputs = inputs.withColumn("_text", F.col("chunk_text")).select(
                "document_id", "chunk_index", *self.carry, "_text"
            )
            inputs = embed_packed(inputs, "_text", self.embedder)
        chunk_cells = inputs.select(
            "*",
            _hash_part(["document_id", "chunk_index"], rows).alias("_row"),
            F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_column"),
        )
        keys, cells = ["_row", "_column"], rows * columns
        if cells <= _CELLS_DEALT:
            # A partition has one cell or none, where hashes of the keys would give some four.
            numbers = F.lit(cell_keys(cells, max(min(_SPREAD * cells, _MOST_PARTITIONS), 1)))
            own = F.get(numbers, F.col("_row") * columns + F.col("_column")).cast("int")
            chunk_cells = chunk_cells.withColumn("_cell", own)
            question_cells = question_cells.withColumn("_cell", own)
            keys = ["_cell"]
        met = self.cell_candidates(chunk_cells, question_cells, keys, cells)
        return self.ranked(met, rows * self.k)

    def _grid(self, count: int, held: int, columns: int) -> tuple[int, int]:
        """Rows and columns: cells are bounded in chunks, questions and pairs, and enough
        for all cores; of such grids, one that repeats few vectors."""
        cores = self.questions.sparkSession.sparkContext.defaultParallelism
        cells = max(count * held / PAIRS_PER_CELL, _CELLS_PER_CORE * cores)
        columns = max(columns, math.ceil(math.sqrt(cells * count / max(held, 1))))
        columns = max(min(columns, count), 1)
        # Each cell begins without a floor, so few cells with many chunks take less time.
        whole = self.embedder is not None and getattr(self.embedder, "whole", False)
        most = CHUNKS_PER_CELL * (_WHOLE_VECTORS if whole else 1)
        rows = max(math.ceil(held / most), math.ceil(cells / columns))
        return max(min(rows, held), 1), columns

    def cell_candidates(
        self, left: DataFrame, right: DataFrame, keys: list[str], cells: int
    ) -> DataFrame:
        """Candidates of chunks and questions that meet in ``cells`` cells of bounded size.

        Their number of partitions is given, so that small input, but long work, is not
        put together into few tasks."""
        search = _Search(self.k, self.min_score, None, self.carry)
        partitions = max(min(_SPREAD * cells, _MOST_PARTITIONS), 1)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = one_array(right.column("query_id"))
            empty = pa.Table.from_batches([], schema=search.schema_of(ids.type, left.schema))
            if not left.num_rows or not right.num_rows:
                return empty
            # What the worker had for the task before.
            pa.default_memory_pool().release_unused()
            matrix = _matrix_of(right)
            found = search.task(ids, matrix, _blocks(left, matrix.shape[1]))
            del matrix
            found = list(found)
            return pa.Table.from_batches(found) if found else empty

        sides = [side.repartition(partitions, *keys).groupBy(*keys) for side in (left, right)]
        cogrouped = sides[0].cogroup(sides[1])
        return cogrouped.applyInArrow(run, self.schema)


class _Vectors:
    """Vectors with their squared lengths, and in single precision with length one."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.squares = np.empty(len(values))
        # A part at a time, as the values take twice their memory here.
        for at in range(0, len(values), _SQUARED_AT_ONCE):
            wide = values[at : at + _SQUARED_AT_ONCE].astype(np.float64)
            np.einsum("ij,ij->i", wide, wide, out=self.squares[at : at + _SQUARED_AT_ONCE])
        self.usable = (self.squares > 0) & np.isfinite(self.squares)

    @cached_property
    def units(self) -> np.ndarray:
        made = np.empty(self.values.shape, np.float32)
        for at in range(0, len(made), _SQUARED_AT_ONCE):
            made[at : at + _SQUARED_AT_ONCE] = self.units_of(slice(at, at + _SQUARED_AT_ONCE))
        return made

    def units_of(self, rows) -> np.ndarray:
        lengths = np.sqrt(np.where(self.usable[rows], self.squares[rows], np.inf))[:, None]
        with np.errstate(invalid="ignore"):
            return (self.values[rows].astype(np.float64) / lengths).astype(np.float32)

    @cached_property
    def are_counts(self) -> bool:
        """Whether the usable vectors hold whole numbers, none of them negative."""
        used = self.values if self.usable.all() else self.values[self.usable]
        return bool((used >= 0).all() and (used == np.rint(used)).all())


class _Counts:
    """Chunks whose vectors hold counts, shortest first, two or three to a row of numbers.

    The product of two such vectors is a whole number, and not above that of their lengths.
    Where that is below 2 ** 8, three of them fit side by side into the 24 digits of a number in
    single precision, and two below 2 ** 12; three below 2 ** 16 into those of one in double
    precision. A product of matrices then gives that many exact ones at a time.

    Chunks of about the same length have one threshold: as many as ``_NUMBERS_TOGETHER`` numbers
    of three, which are not next to each other. A tile has the first numbers of its
    thresholds, then the second ones, and so on, so that what is compared at once is long.
    """

    def __init__(self, held: _Vectors, rows: np.ndarray) -> None:
        self.rows = rows[np.argsort(held.squares[rows], kind="stable")]
        self.values = held.values
        lengths = np.sqrt(held.squares[self.rows])
        self.together = _NUMBERS_TOGETHER * _SHARES
        #: Of the chunks with one threshold.
        self.shortest = lengths[:: self.together]
        ends = np.arange(1, len(self.shortest) + 1) * self.together - 1
        self.longest = lengths[np.minimum(ends, len(lengths) - 1)]
        self._numbers: dict[tuple, np.ndarray] = {}
        self._places: dict[tuple, np.ndarray] = {}

    def places(self, shares: int, start: int, end: int) -> np.ndarray:
        """The chunks of the thresholds from ``start`` to ``end``, by the shares of the numbers of
        their tile, places beyond the last chunk among them."""
        if (shares, start, end) not in self._places:
            spread = np.arange(self.together).reshape(-1, 1, shares)
            made = np.arange(start, end)[:, None] * self.together + spread
            self._places[shares, start, end] = made.reshape(-1)
        return self._places[shares, start, end]

    def numbers(self, bound: int, shares: int, kind: type, start: int, end: int) -> np.ndarray:
        """Rows of numbers for the thresholds from ``start`` to ``end``."""
        if (bound, start, end) not in self._numbers:
            places = self.places(shares, start, end)
            known = np.minimum(places, len(self.rows) - 1)
            # Chunks too long for this form are not asked for.
            whole = np.minimum(self.values[self.rows[known]], bound, dtype=kind)
            # Zeros in place of chunks that the last threshold lacks.
            whole[places >= len(self.rows)] = 0
            made = whole[shares - 1 :: shares] * kind(bound)
            for share in range(shares - 2, 0, -1):
                made += whole[share::shares]
                made *= kind(bound)
            made += whole[::shares]
            self._numbers[bound, start, end] = made
        return self._numbers[bound, start, end]


def _cosines(asked: _Vectors, held: _Vectors, question, row) -> np.ndarray:
    # The last bits depend on how a product is summed; equal vectors must come out
    # equal wherever they lie.
    products = np.einsum(
        "ij,ij->i",
        asked.values[question].astype(np.float64),
        held.values[row].astype(np.float64),
    )
    lengths = np.sqrt(asked.squares[question] * held.squares[row])
    return np.round(products / lengths, _SCORE_DIGITS)


def _places(hit: np.ndarray) -> np.ndarray:
    """Places of the few true values of an array, looked for in 64 at a time, then eight."""
    flat = hit.reshape(-1)
    even = len(flat) // 64 * 64
    words = flat[:even].view(np.uint64).reshape(8, -1)
    columns = np.flatnonzero(np.bitwise_or.reduce(words, axis=0))
    at, column = np.nonzero(words[:, columns])
    places = ((at * words.shape[1] + columns[column])[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.r_[np.sort(places[flat[places]]), even + np.flatnonzero(flat[even:])]


class _Search:
    """The k best chunks per question among the Arrow batches of one task."""

    def __init__(
        self, k: int, min_score: float, embedder: Embedder | None, carry: list[str]
    ) -> None:
        self.k = k
        self.min_score = min_score
        self.embedder = embedder
        self.carry = carry
        self.buffers: dict[tuple, np.ndarray] = {}

    def schema_of(self, ids: pa.DataType, chunks: pa.Schema) -> pa.Schema:
        fields = [
            ("query_id", ids),
            ("document_id", pa.int64()),
            ("chunk_index", pa.int64()),
            ("score", pa.float64()),
        ]
        return pa.schema([*fields, *[(name, chunks.field(name).type) for name in self.carry]])

    def task(
        self,
        ids: pa.Array,
        matrix: np.ndarray,
        batches: Iterator[pa.RecordBatch],
    ) -> Iterator[pa.RecordBatch]:
        """Candidates of the whole task, given out once at its end.

        What is kept in between is k rows per question.
        """
        if not len(ids):
            return
        asked = _Vectors(matrix)
        floor = np.where(asked.usable, self.min_score, np.inf)
        rows_at_once = max(_SCORES_PER_BLOCK // min(len(ids), _QUESTIONS_PER_BLOCK), 1)
        seen, first = 0, rows_at_once
        self.by_length = None
        if asked.are_counts:
            # Questions by length, and one copy of them.
            order = np.argsort(asked.squares, kind="stable")
            ids, asked, floor = ids.take(pa.array(order)), None, floor[order]
            asked = _Vectors(matrix[order])
            self.by_length = np.flatnonzero(asked.usable)
            first = min(rows_at_once, _FIRST_CHUNKS)
            counted_at_once = max(rows_at_once, _COUNTED_VALUES // matrix.shape[1])
        del matrix
        parts: list[pa.Table] = []
        unsorted, fresh = 0, True
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                most = rows_at_once
                if self.by_length is not None and not fresh and floor.min() > _SCORE_SLACK:
                    most = counted_at_once
                # Few at first: a floor from few chunks lets many of the next ones pass.
                block = batch.slice(start, min(max(_GROWTH * seen, first), most))
                start += block.num_rows
                seen += block.num_rows
                found = self._block(asked, floor, block, fresh)
                parts += found
                unsorted += sum(part.num_rows for part in found)
                if parts and (fresh or unsorted > 2 * self.k * len(ids)):
                    best, floor = self._best_of(pa.concat_tables(parts), floor)
                    parts, unsorted, fresh = [best], 0, False
        if not parts:
            return
        best, _ = self._best_of(pa.concat_tables(parts), floor)
        named = ids.take(one_array(best.column("_question")))
        best = best.drop_columns(["_question"]).add_column(0, "query_id", named)
        yield from best.combine_chunks().to_batches()

    def _block(self, asked: _Vectors, floor, block, fresh: bool) -> list[pa.Table]:
        """Candidates among a block of chunks, for one tile of questions after another."""
        if self.embedder:
            made = np.asarray(self.embedder(block.column("chunk_text").to_pylist()))
            # As `embed` stores them.
            held = _Vectors(made.astype(np.float32))
        elif "packed" in block.schema.names:
            held = _Vectors(unpacked_vectors(block.column("packed"), asked.values.shape[1]))
        else:
            held = _Vectors(as_matrix(block.column("embedding")))
        if len(held.values) and held.values.shape[1] != asked.values.shape[1]:
            raise ValueError(f"vectors must all have {asked.values.shape[1]} values")
        rows = np.flatnonzero(held.usable)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if not len(rows):
            return []
        if fresh or self.by_length is None or not held.are_counts:
            pairs = self._compared(asked, np.arange(len(asked.values)), floor, held, rows, fresh)
        else:
            pairs = self._counted(asked, floor, held, rows)
        for question, row, score in pairs:
            good = (score > self.min_score) & (score >= floor[question])
            found.append((question[good], row[good], score[good]))
        question, row, score = (np.concatenate(part) for part in zip(*found))
        return [self._candidates(block, row, question, score)] if len(row) else []

    def _compared(self, asked, questions, floor, held, rows, fresh: bool) -> Iterator[tuple]:
        """(question, row, score) of the pairs that can be among the best, by their cosines
        in single precision."""
        if not len(questions):
            return
        units = held.units_of(rows)
        at_once = max(min(_QUESTIONS_PER_BLOCK, _SCORES_PER_BLOCK // len(rows)), 1)
        for start in range(0, len(questions), at_once):
            tile = questions[start : start + at_once]
            # Counts are hardly ever compared so.
            near = asked.units[tile] if self.by_length is None else asked.units_of(tile)
            question, row = self._reaching(near, floor[tile], units, fresh)
            question, row = tile[question], rows[row]
            score = np.empty(len(row))
            step = max(_EXACT_VALUES // asked.values.shape[1], 1)
            for at in range(0, len(row), step):
                part = slice(at, at + step)
                score[part] = _cosines(asked, held, question[part], row[part])
            yield question, row, score

    def _counted(self, asked, floor, held, rows) -> Iterator[tuple]:
        """The same for vectors of counts, by their exact products.

        Questions come by length, so that those of a tile take about the same chunks in the
        same form. Pairs too long for any form are compared, and questions whose floor a
        product of zero reaches."""
        counts = _Counts(held, rows)
        usable = self.by_length
        low = floor[usable] <= _SCORE_SLACK
        yield from self._compared(asked, usable[low], floor, held, rows, False)
        usable = usable[~low]
        wide = max(_NUMBERS_PER_TILE // _NUMBERS_TOGETHER, 1)
        for start in range(0, len(usable), _COUNTED_QUESTIONS):
            tile = usable[start : start + _COUNTED_QUESTIONS]
            lengths = np.sqrt(asked.squares[tile])
            least = (floor[tile] - _SCORE_SLACK) * lengths
            # Single precision gives a threshold that is too high by less than this.
            below = (least * (1 - 2.0**-20)).astype(np.float32)[:, None]
            done = 0
            for bound, shares, kind, whole, share in _SHARED:
                end = int(np.searchsorted(counts.longest * lengths[-1], bound - 1))
                if done < end:
                    own = asked.values[tile].astype(kind, copy=False)
                while done < end:
                    # Tiles begin at the same places for all questions.
                    until = min((done // wide + 1) * wide, end)
                    numbers = counts.numbers(bound, shares, kind, done, until)
                    needed = below * counts.shortest[done:until].astype(np.float32)
                    np.minimum(np.ceil(needed, out=needed), bound - 1, out=needed)
                    find = self._shares if share else self._halves
                    question, place, product = find(own, numbers, needed, whole, share or bound)
                    row = counts.rows[counts.places(shares, done, until)[place]]
                    # What its own length rules out, before its score is worked out.
                    near = product >= least[question] * np.sqrt(held.squares[row])
                    question, row, product = tile[question[near]], row[near], product[near]
                    length = np.sqrt(asked.squares[question] * held.squares[row])
                    yield question, row, np.round(product / length, _SCORE_DIGITS)
                    done = until
            rest = counts.rows[done * counts.together :]
            if len(rest):
                yield from self._compared(asked, tile, floor, held, rest, False)

    def _products(self, values, numbers, whole) -> np.ndarray:
        near = self._buffer("near", (len(values), len(numbers)), values.dtype)
        np.matmul(values, numbers.T, out=near)
        products = self._buffer("products", near.shape, whole)
        np.copyto(products, near, casting="unsafe")
        return products

    def _shares(
        self, values, numbers, needed, whole, share
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, place, product) where a share of the numbers' products reaches what is
        needed, above zero, of the chunks with one threshold."""
        products = self._products(values, numbers, whole)
        # Thresholds of the shares of a number; its last share is always zero.
        most = np.iinfo(share).max
        every_share = sum((most + 1) ** at for at in range(_SHARES))
        shares = needed.astype(whole) * whole(every_share)
        shares = shares.view(share).reshape(*needed.shape, _SHARES + 1)
        shares[..., _SHARES] = most
        every = products.view(share).reshape(len(values), _NUMBERS_TOGETHER, -1)
        hit = self._buffer("hit", (len(values), every[0].size), np.bool_)
        np.greater_equal(every, shares.reshape(len(values), 1, -1), out=hit.reshape(every.shape))
        places = _places(hit)
        question, place = np.divmod(places, max(hit.shape[1], 1))
        number, at = np.divmod(place, _SHARES + 1)
        return question, number * _SHARES + at, every.reshape(-1)[places].astype(np.float64)

    def _halves(
        self, values, numbers, needed, whole, bound
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for two shares to a number, which have no kind of their own."""
        high = self._products(values, numbers, whole)
        low = self._buffer("low", high.shape, whole)
        np.bitwise_and(high, whole(bound - 1), out=low)
        least = needed.astype(whole)[:, None, :]
        hit = self._buffer("hit", high.shape, np.bool_)
        found = []
        for at, (products, unit) in enumerate(((low, 1), (high, bound))):
            every = products.reshape(len(values), -1, needed.shape[1])
            np.greater_equal(every, least * whole(unit), out=hit.reshape(every.shape))
            places = _places(hit)
            question, number = np.divmod(places, max(hit.shape[1], 1))
            product = (products.reshape(-1)[places] // whole(unit)).astype(np.float64)
            found.append((question, number * 2 + at, product))
        return tuple(np.concatenate(part) for part in zip(*found))

    def _reaching(self, asked, floor, units, fresh: bool) -> tuple[np.ndarray, np.ndarray]:
        """(question, row) of the pairs that can be among the best.

        A pair stays if it may reach the k-th best so far, or of the first block. The
        slack is what a product of unit vectors in single precision can be off by, twice
        for that k-th best, so equal scores stay until they are ordered by document.
        """
        slack = (asked.shape[1] + 16) * 2.0**-24
        near = self._buffer("near", (len(asked), len(units)), np.float32)
        np.matmul(asked, units.T, out=near)
        least = floor - slack
        if fresh and len(units) > self.k:
            kth = np.partition(near, len(units) - self.k, axis=1)[:, len(units) - self.k]
            least = np.maximum(least, kth - 2 * slack)
        hit = self._buffer("hit", near.shape, np.bool_)
        np.greater_equal(near, least[:, None].astype(np.float32), out=hit)
        return np.divmod(_places(hit), max(len(units), 1))

    def _buffer(self, name: str, shape: tuple[int, int], kind) -> np.ndarray:
        """Memory that a task uses again: to get it anew can take as long as to fill it."""
        size = shape[0] * shape[1]
        if (name, kind) not in self.buffers or self.buffers[name, kind].size < size:
            self.buffers[name, kind] = np.empty(size, kind)
        return self.buffers[name, kind][:size].reshape(shape)

    def _candidates(self, block, row, question, score) -> pa.Table:
        taken = block.select(["document_id", "chunk_index", *self.carry]).take(pa.array(row))
        columns = {"_question": pa.array(question)}
        columns.update({name: taken.column(name) for name in ("document_id", "chunk_index")})
        columns["score"] = pa.array(score)
        columns.update({name: taken.column(name) for name in self.carry})
        return pa.table(columns)

    def _best_of(self, table: pa.Table, floor: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        question = table.column("_question").to_numpy()
        score = table.column("score").to_numpy()
        order = np.lexsort(
            (
                table.column("chunk_index").to_numpy(),
                table.column("document_id").to_numpy(),
                -score,
                question,
            )
        )
        question, score = question[order], score[order]
        starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        counts = np.diff(np.r_[starts, len(question)])
        rank = np.arange(len(question)) - np.repeat(starts, counts)
        keep = rank < self.k
        full = rank == self.k - 1
        floor = floor.copy()
        floor[question[full]] = score[full]
        return table.take(pa.array(order[keep])), floor


def _measure(questions: DataFrame) -> tuple[int, int]:
    """Number of questions and width of their vectors."""
    count = questions.count()
    if _vector_column(questions) == "packed":
        first = questions.select("packed").head()
        return count, packed_width(bytes(first["packed"])) if first else 0
    first = questions.select(F.size("embedding").alias("width")).head()
    return count, max(first["width"], 0) if first else 0


def _vector_column(questions: DataFrame) -> str:
    return "packed" if "packed" in questions.columns else "embedding"


def _matrix_of(questions: pa.Table) -> np.ndarray:
    if "packed" not in questions.column_names:
        return as_matrix(one_array(questions.column("embedding")))
    packed = one_array(questions.column("packed"))
    return unpacked_vectors(packed, packed_width(packed[0].as_py()))


def _collect_questions(questions: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Ids and matrix of questions whose size has been checked."""
    table = questions.select("query_id", _vector_column(questions)).toArrow()
    ids = one_array(table.column("query_id"))
    if not len(ids):
        return ids, np.zeros((0, 1))
    return ids, _matrix_of(table)


def _blocks(chunks: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of a cell in batches of as many as are compared at once."""
    rows = max(_COUNTED_VALUES // max(width, 1), 1)
    for start in range(0, chunks.num_rows, rows):
        yield from chunks.slice(start, rows).combine_chunks().to_batches()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column's values as one array."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)
    return whole


def cell_keys(cells: int, partitions: int) -> list[int]:
    """A number for each cell, such that Spark's hash deals the cells evenly to partitions.

    Other hashes would deal them less evenly, and no less right."""
    numbers = np.arange(32 * max(cells, partitions), dtype=np.uint32)
    part = _hash_of(numbers).astype(np.int32).astype(np.int64) % partitions
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], np.arange(partitions))
    wanted, turn = np.arange(cells) % partitions, np.arange(cells) // partitions
    keys = numbers[order[np.minimum(first[wanted] + turn, len(order) - 1)]].tolist()
    return keys if len(set(keys)) == cells else list(range(cells))


def _hash_of(numbers: np.ndarray) -> np.ndarray:
    """Murmur3 of 32-bit numbers, with the seed that Spark deals rows by."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    mixed = turned(numbers * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    mixed = turned(np.uint32(42) ^ mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    mixed ^= np.uint32(4)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        mixed = (mixed ^ (mixed >> np.uint32(by))) * np.uint32(factor)
    return mixed ^ (mixed >> np.uint32(16))


def _hash_part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def with_chunk_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the text of ranked chunks. Texts take no part in the ranking; they join
    its result, k rows per question."""
    texts = chunks.select(
        F.col("document_id").cast("long").alias("document_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "chunk_text",
    )
    return ranked.join(texts, ["document_id", "chunk_index"])


def with_window_text(
    ranked: DataFrame,
    documents: DataFrame,
    most: int | None = None,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """Add the text of ranked fixed windows from the documents (``document_id, text``) they
    were cut from: a window's place follows from its index, so nothing is cut again.

    ``most``: how many ranked rows there can be, k for each question. While they may be
    sent to every task, documents stay where they are.
    """
    winners = F.broadcast(ranked) if most is not None and most <= RANKED_SENT else ranked
    start = F.col("chunk_index") * (size - overlap) + 1
    texts = documents.select(F.col("document_id").cast("long").alias("document_id"), "text")
    found = F.substr("text", start.cast("int"), F.lit(size))
    return winners.join(texts, "document_id").select(*ranked.columns, found.alias("chunk_text"))


def contexts(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per question (``query_id, query``), its chunk texts in rank order joined by
    blank lines; empty when there are none. A group holds k rows."""
    return questions.select("query_id", "query").join(
        ranked.groupBy("query_id").agg(_joined(F.col("chunk_text"), "\n\n").alias("_context")),
        "query_id",
        "left",
    ).select("query_id", "query", F.coalesce("_context", F.lit("")).alias("context"))


def excerpts(questions: DataFrame, ranked: DataFrame, none_found: str) -> DataFrame:
    """Per question, its chunks with their source ``[document#chunk]``, or a message."""
    sourced = F.concat(
        F.lit("["),
        F.col("document_id").cast("string"),
        F.lit("#"),
        F.col("chunk_index").cast("string"),
        F.lit("] "),
        F.col("chunk_text"),
    )
    return questions.select("query_id", "query").join(
        ranked.groupBy("query_id").agg(_joined(sourced, "\n\n").alias("_excerpts")),
        "query_id",
        "left",
    ).select("query_id", "query", F.coalesce("_excerpts", F.lit(none_found)).alias("excerpts"))


def _joined(text: Column, separator: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return F.array_join(F.transform(items, lambda item: item["text"]), separator)

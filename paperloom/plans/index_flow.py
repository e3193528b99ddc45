"""A stored index of chunk vectors, laid out by cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from paperloom import fixed_values as fixed
from paperloom.operators import postings, quantised, retrieval
from paperloom.sources.tables import table_path

INDEX_TABLE = "chunk_index_cells"
CENTRE_TABLE = "chunk_index_centres"
CODE_TABLE = "chunk_index_codes"
BOOK_TABLE = "chunk_index_books"
COUNT_TABLE = "chunk_word_counts"
POSTING_TABLE = "chunk_postings"


def build_index(embeddings: DataFrame, store: str, cells: int) -> None:
    """Write chunk vectors (``document_id, chunk_index, embedding``) by cell.

    Rows are rebalanced by cell: small cells are written by one task each, so
    that files stay large, and a cell that holds much of the table by many.
    """
    spark = embeddings.sparkSession
    centres = retrieval.train_cells(embeddings, cells)
    placed = retrieval.assign_cells(
        embeddings.select("document_id", "chunk_index", "embedding").filter("embedding IS NOT NULL"),
        centres,
    )
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(
        table_path(store, INDEX_TABLE)
    )
    rows = [(cell, centre.tolist()) for cell, centre in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(table_path(store, CENTRE_TABLE))


def search_index(
    questions: DataFrame,
    store: str,
    probes: int,
    k: int = fixed.TOP_K,
    min_score: float | None = None,
) -> DataFrame:
    """The k best chunks of each question's ``probes`` nearest cells."""
    spark = questions.sparkSession
    return retrieval.approximate_top_k(
        questions,
        spark.read.parquet(table_path(store, INDEX_TABLE)),
        stored_centres(spark, store),
        probes,
        k,
        min_score,
    )


def stored_centres(spark: SparkSession, store: str) -> np.ndarray:
    """The index's centres: as many as its cells, a fixed number."""
    rows = spark.read.parquet(table_path(store, CENTRE_TABLE)).orderBy("cell").collect()
    return np.array([row.centre for row in rows])


def build_quantised_index(
    embeddings: DataFrame,
    store: str,
    cells: int,
    parts: int | None = None,
    sample: int = quantised.TRAINED_ON,
) -> None:
    """Fit a quantiser on a bounded sample and write every vector's code, by cell, next to
    the vector. Readers of codes do not read the vectors' column."""
    spark = embeddings.sparkSession
    fitted = quantised.train(embeddings, cells, parts, sample)
    rows = [(-1, cell, centre.tolist()) for cell, centre in enumerate(fitted.centres)]
    rows += [
        (part, start, entries.ravel().tolist()) for part, (start, entries) in enumerate(fitted.books)
    ]
    spark.createDataFrame(rows, "part int, at int, entries array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(table_path(store, BOOK_TABLE))
    placed = quantised.encode(embeddings, fitted)
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(
        table_path(store, CODE_TABLE)
    )


def quantised_index(spark: SparkSession, store: str) -> tuple[DataFrame, quantised.Quantiser]:
    """The stored codes, and the quantiser: a row for each cell and each part of a vector."""
    rows = spark.read.parquet(table_path(store, BOOK_TABLE)).orderBy("part", "at").collect()
    centres = np.array([row.entries for row in rows if row.part < 0])
    starts = [row.at for row in rows if row.part >= 0] + [centres.shape[1]]
    books = [
        (row.at, np.array(row.entries).reshape(-1, end - row.at))
        for row, end in zip((row for row in rows if row.part >= 0), starts[1:])
    ]
    codes = spark.read.parquet(table_path(store, CODE_TABLE))
    return codes, quantised.Quantiser(centres, books)


def search_quantised(
    questions: DataFrame, store: str, probes: int, k: int = fixed.TOP_K, keep: int | None = None
) -> DataFrame:
    """The k best of the vectors whose codes come closest, in the ``probes`` nearest cells."""
    index, fitted = quantised_index(questions.sparkSession, store)
    return quantised.approximate_top_k(questions, index, fitted, probes, k, keep)


def search_by_bounds(questions: DataFrame, store: str, k: int = fixed.TOP_K) -> DataFrame:
    """The k best of all vectors, leaving out what bounds show cannot be among them."""
    index, fitted = quantised_index(questions.sparkSession, store)
    return quantised.exact_top_k(questions, index, fitted, k)


def build_postings(
    chunks: DataFrame, store: str, per_shard: int = postings.CHUNKS_PER_SHARD
) -> None:
    """Write the inverted index of the chunks' words (``document_id, chunk_index,
    chunk_text``), by buckets of words. The counts are stored on the way, as they are used
    twice; tasks that put shards together write all buckets."""
    spark = chunks.sparkSession
    counts = table_path(store, COUNT_TABLE)
    counted = postings.shard_counts(chunks, per_shard)
    counted.write.mode("overwrite").parquet(counts)
    made = postings.posting_lists(spark.read.schema(counted.schema).parquet(counts))
    made.sortWithinPartitions("bucket", "shard").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(table_path(store, POSTING_TABLE))


def stored_postings(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(postings.POSTING_SCHEMA).parquet(table_path(store, POSTING_TABLE))


def search_postings(questions: DataFrame, store: str, k: int = fixed.TOP_K) -> DataFrame:
    """The k chunks of the most similar words to each question (``query_id, query``)."""
    return postings.search(questions, stored_postings(questions.sparkSession, store), k)

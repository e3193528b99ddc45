"""The corpus pipeline: documents in, cleaned and encoded documents out.

Each stage takes what the one before it kept, as (spark, docs, sf_dir), and returns a
DataFrame; ``run`` writes each to the shared folder as Parquet and reads it back, so a
lost executor costs no more than the stage it was lost in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import stored, table
from paperloom.llm.decontamination import find_leaks
from paperloom.llm.language_id import identify
from paperloom.llm.line_dedup import remove_repeated_lines
from paperloom.llm.near_dedup import Plan, one_of_each
from paperloom.llm.piece_encoding import encode_documents
from paperloom.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told, or that fit none of the languages, go."""
    rejected = identify(docs).filter(~F.col("kept")).select("doc_id", "text_key").distinct()
    rejected = rejected.withColumnRenamed("doc_id", "rejected_id")
    same = docs["doc_id"].eqNullSafe(rejected["rejected_id"]) & (
        F.xxhash64(docs["text"]) == rejected["text_key"]
    )
    return docs.join(rejected, same, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of three lines that occurred before go; every document stays."""
    cleaned = remove_repeated_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8."""
    return one_of_each(docs, Plan(width=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, and what they decode to, as a digest."""
    encoded = encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("piece_encoding", pieces),
]

#: SQL can express neither the first stage nor the last; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

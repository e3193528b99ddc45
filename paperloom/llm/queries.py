"""The registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import (
    ann,
    decontamination,
    fill_middle,
    hard_negatives,
    html_text,
    language_id,
    line_dedup,
    lm_scoring,
    near_dedup,
    piece_encoding,
    quality,
    token_store,
    toxicity,
    url_filter,
)
from paperloom.llm.common import shared_folder, stored, table

#: A folder with the public vocabulary files, where it is not the installed package's.
TOKENIZERS = os.environ.get("TOKENIZER_FOLDER")
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def tokenizer_file(name: str) -> str:
    return f"{TOKENIZERS}/{name}" if TOKENIZERS else str(public_tokenizers.path(name))


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lm_scoring.score_documents(docs)


def op2_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = token_store.new_path(shared_folder(spark))
    token_store.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"))
    return token_store.read_documents(spark, path).select(
        "doc_id", "start", "n_tokens", token_store.ids_crc32(F.col("ids")).alias("ids_crc32")
    )


def op4_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = tokenizer_file("piece_bpe_32k.model")
    return piece_encoding.encode_documents(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs).drop("text_key")


def op5_page_language(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages: the language their markup declares, their host and its last label."""
    host = url_filter.host_and_path(F.col("url"))[0]
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:\d*)?$", "")
    last = F.regexp_extract("host", r"(?:^|\.)([^.]*[^.\d][^.]*)$", 1)
    pages = table(spark, folder, "pages").select(
        "page_id",
        html_text.text_of(F.col("html")).alias("text"),
        html_text.declared_language(F.col("html")).alias("lang"),
        F.nullif(host, F.lit("")).alias("host"),
    )
    pages = pages.withColumn("suffix", F.nullif(last, F.lit("")))
    found = language_id.identify(pages, doc_id="page_id", host="host", suffix=F.col("suffix"))
    return found.withColumnRenamed("doc_id", "page_id").drop("text_key")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), "leaks")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs).select(
        "doc_id",
        F.col("lines_total").alias("n_lines"),
        F.size("lines_removed").alias("n_removed"),
        F.md5(F.coalesce(F.array_join("lines_removed", ","), F.lit(""))).alias("removed_md5"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, near_dedup.Plan(width=2)).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op9_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """As many documents are sampled as the labels let expect good ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    k = round(quality.labelled_share(labels, good) * docs.count())
    return quality.resample(docs, labels.filter(good), k).drop("text_key")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules=URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh row are shifted, as if they were wrong."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
    return hard_negatives.mine(
        vectors, F.col("vec_id") % 100 == 0, label=shifted.otherwise(F.col("label"))
    )


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    remainder = toxicity.remainder(F.col("doc_id"), 4)
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(remainder != 2)
    scored = toxicity.score_documents(docs, toxicity.learn(docs, labels))
    return scored.select(
        "doc_id",
        (remainder == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    frames = stored(fill_middle.store_frames(docs), "frames", compression="uncompressed")
    return fill_middle.transform(frames, texts=False, digests=True)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_token_store": op3_token_store,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_resampling": op9_quality_resampling,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Operators over further tables.
MORE_QUERIES = {"op5_page_language": op5_page_language}

"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs: one of target texts, one of
all. A document's weight is the ratio of its likelihoods, in log and per feature, so
that length does not decide; Gumbel noise added to it turns the k largest into a
sample without replacement, drawn by the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored
from paperloom.llm.words import chained, text_slices, word_hashes


class Plan(NamedTuple):
    """``scale``: features that a document's mean log-ratio counts for against noise of
    unit scale. ``labelled``: most target rows the target model is fitted on, drawn by
    a hash of their ids."""

    bits: int = 16
    added: float = 1.0
    scale: float = 50.0
    labelled: int = 200_000
    seed: int = 17


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of words and of pairs within a text."""
    hashes, offsets = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = chained(hashes, 2)
    same = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    shift = np.uint64(64 - bits)
    buckets = np.concatenate([hashes, pairs[same[: len(pairs)]]]) >> shift
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def learn(rows: DataFrame, plan: Plan) -> np.ndarray:
    """Log-ratio of target to raw probability for each bucket, from ``text`` and the flag
    ``target``. Counts are summed in each task, then by bucket; the plan fixes how
    many there are."""
    size = 1 << plan.bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            texts, target = batch["text"].tolist(), batch["target"].to_numpy(bool)
            for first, last in text_slices(texts):
                buckets, owner = features(texts[first:last], plan.bits)
                total[0] += np.bincount(buckets, minlength=size)
                good = target[first:last][owner]
                total[1] += np.bincount(buckets[good], minlength=size)
        bucket = np.flatnonzero(total[0])
        yield pd.DataFrame(
            {"bucket": bucket, "n_raw": total[0][bucket], "n_target": total[1][bucket]}
        )

    counted = rows.mapInPandas(count, "bucket int, n_raw long, n_target long")
    sums = counted.groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_target").alias("t"))
    raw, target = np.full(size, plan.added), np.full(size, plan.added)
    for bucket, r, t in sums.collect():
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(*columns: str, seed: int) -> Column:
    """Standard Gumbel noise, a function of the columns."""
    mantissa = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    uniform = (mantissa.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column without nulls, null if there are fewer rows.

    The range that holds it is cut into equal parts, counted, and narrowed to the part
    it lies in, until that part's values are one; no row leaves its task."""
    parts = 4_096
    low, high, count = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if count < k or k < 1:
        return None
    while low < high:
        inside = rows.filter(F.col(column).between(low, high))
        width = (high - low) / parts
        cut = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1))
        table = (
            inside.groupBy(cut.alias("part"))
            .agg(F.count(F.lit(1)), F.min(column), F.max(column))
            .collect()
        )
        for _, n, least, most in sorted(table, reverse=True):
            if k <= n:
                low, high = least, most
                break
            k -= n
    return low


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    k: int,
    plan: Plan = Plan(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, text_key, log_weight, sample_key, kept) of every document; the k with the
    largest sample_key are kept, and those that tie with the last of them.

    ``target_ids`` (doc_id) names documents of the target; null ids and ids without a
    document do nothing, repeated ones count once. Null and empty texts and texts of
    white space have weight 0, as if drawn from either model. Equal rows get equal
    keys. With no target every weight is 0 and chance decides. An empty table gives
    an empty table; k of the number of rows or more keeps all.

    The target's ids are sent to all tasks: at most ``labelled`` numbers, which is the
    bound of what is broadcast. No text is shuffled.
    """
    ids = target_ids.select(F.col(doc_id).cast("long").alias("_target_id")).distinct()
    ids = ids.filter(F.col("_target_id").isNotNull())
    ids = ids.orderBy(F.xxhash64("_target_id"), "_target_id").limit(plan.labelled)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(text).alias("text"),
    )
    flagged = rows.join(
        F.broadcast(ids.withColumn("target", F.lit(True))),
        F.col("doc_id") == F.col("_target_id"),
        "left",
    ).select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(flagged, plan))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio = sent.value
        for batch in batches:
            texts = batch["text"].tolist()
            for first, last in text_slices(texts):
                buckets, owner = features(texts[first:last], plan.bits)
                sums = np.bincount(owner, ratio[buckets], minlength=last - first)
                count = np.bincount(owner, minlength=last - first)
                part = batch.iloc[first:last][["doc_id", "text_key"]]
                yield part.assign(log_weight=plan.scale * sums / np.maximum(count, 1))

    weights = rows.mapInPandas(weigh, "doc_id long, text_key long, log_weight double")
    keyed = stored(
        weights.withColumn(
            "sample_key", F.col("log_weight") + gumbel("doc_id", "text_key", seed=plan.seed)
        ),
        "weights",
    )
    total = keyed.count()
    least = kth_largest(keyed, "sample_key", k) if k < total else None
    kept = F.lit(k > 0) if least is None else F.col("sample_key") >= least
    return keyed.withColumn("kept", kept)


def labelled_share(labels: DataFrame, good: Column) -> float:
    """Share of the labelled rows that are good; 1 without labels."""
    some, all_rows = labels.agg(F.count(F.when(good, 1)), F.count(F.lit(1))).first()
    return some / all_rows if all_rows else 1.0

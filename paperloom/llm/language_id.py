"""Language identification by fusing evidence.

Evidence of a document: its text (hashed character trigrams), the language its
markup declares, the suffix of its address, and its host. Everything is learned from
the corpus: trigram counts by declared language; how often declarations and suffixes
go with each language as the text tells it; and the mix of languages of each host,
smoothed by that of its parent domains and of the whole. The posterior is their
product, with the text's part tempered, since neighbouring trigrams overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored


class Plan(NamedTuple):
    """``languages``: those to tell apart; None takes the languages that at least
    ``declared`` rows declare, and one in 1 / ``share`` of those that declare any:
    declarations that are slips are not learned. ``weight``: share of a trigram's log-likelihood that
    counts. ``pull``: documents a parent's mix is worth to its child. ``least``:
    posterior below which a document is rejected as undecided. ``margin``: how much
    likelier than chance, in nats a trigram, a text must be in its language; below, it
    is in none of them."""

    languages: tuple[str, ...] | None = None
    declared: int = 10
    share: float = 1e-4
    bits: int = 15
    weight: float = 0.3
    added: float = 0.5
    pull: float = 20.0
    least: float = 0.5
    margin: float = 0.5


#: Characters that are looked at together; each takes some 60 bytes meanwhile.
_SLICE_CHARS = 500_000


def _hashes(joined: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of the middle characters) of trigrams with at least two letters."""
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = (codes >= 0xC0) | ((codes >= 0x61) & (codes <= 0x7A))
    count = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:]
    middle = np.flatnonzero(count >= 2) + 1
    plain = np.where(letter, codes, np.uint32(0x20))
    hashed = plain[middle - 1].astype(np.uint64) << np.uint64(42)
    hashed ^= plain[middle].astype(np.uint64) << np.uint64(21)
    hashed ^= plain[middle + 1]
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    hashed >>= np.uint64(64 - bits)
    return hashed.astype(np.int64), middle


def trigrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of the trigrams with at least two letters, A-Z and other
    letters lower-cased. Digits and marks count as spaces.

    Texts are parted by two spaces, so of a trigram with two letters the middle
    character always lies in the text that the letters are from."""
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 2 for t in lowered])
    hashed, middle = _hashes("  " + "  ".join(lowered) + "  ", bits)
    return hashed, np.searchsorted(ends, middle - 2, "right")


Part = tuple[np.ndarray, np.ndarray]


def trigram_runs(
    texts: list[str | None], bits: int, chars: int = _SLICE_CHARS
) -> Iterator[tuple[int, int, Iterator[Part]]]:
    """(first, last, parts): runs of texts of about ``chars`` characters in one part
    each. A longer text is a run by itself, its parts cut where they would be cut alone,
    so what is summed up for a text does not depend on its neighbours."""

    def of_long(text: str) -> Iterator[Part]:
        padded = f" {text.lower()} "
        for at in range(0, len(padded) - 2, chars):
            hashed, middle = _hashes(padded[at : at + chars + 2], bits)
            yield hashed, np.zeros(len(middle), np.int64)

    first, size = 0, 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if first < i and size + length > chars:
            yield first, i, iter([trigrams(texts[first:i], bits)])
            first, size = i, 0
        if length > chars:
            yield i, i + 1, of_long(text or "")
            first = i + 1
        else:
            size += length
    if first < len(texts):
        yield first, len(texts), iter([trigrams(texts[first:], bits)])


def declared_languages(rows: DataFrame, plan: Plan) -> tuple[str, ...]:
    """The languages that enough rows declare, in order of their codes. Codes have two
    or three letters, so there are never many."""
    code = F.col("declared").rlike("^[a-z]{2,3}$")
    counted = rows.filter(code).groupBy("declared").count().collect()
    least = max(plan.declared, plan.share * sum(row["count"] for row in counted))
    return tuple(sorted(row["declared"] for row in counted if row["count"] >= least))


def _counts(rows: DataFrame, names: list[str], bits: int) -> DataFrame:
    """(language, bucket, n): trigrams by declared language, summed in each task first."""
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), size), np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            declared = pd.Categorical(batch["declared"], names).codes
            for first, last, parts in trigram_runs(texts, bits):
                for hashed, owner in parts:
                    language = declared[first:last][owner]
                    for code in np.unique(language[language >= 0]):
                        total[code] += np.bincount(hashed[language == code], minlength=size)
        language, bucket = np.nonzero(total)
        yield pd.DataFrame({"language": language, "bucket": bucket, "n": total[language, bucket]})

    counted = rows.select("text", "declared").mapInPandas(count, "language int, bucket int, n long")
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, languages: list[str], plan: Plan) -> np.ndarray:
    """Log-probabilities (language, bucket). Their number is fixed by the plan and the
    languages there are, so they may be collected and sent to all tasks."""
    counts = np.zeros((len(languages), 1 << plan.bits))
    for language, bucket, n in _counts(rows, languages, plan.bits).collect():
        counts[language, bucket] = n
    return np.log((counts + plan.added) / (counts + plan.added).sum(axis=1, keepdims=True))


def _text_evidence(rows: DataFrame, table: np.ndarray, plan: Plan) -> DataFrame:
    """The rows without their text, with the sums of log-likelihoods and trigram counts."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in rows.columns if c != "text"]
    schema = rows.select(
        *keep, F.lit(None).cast("array<double>").alias("likely"), F.lit(0).alias("trigrams")
    ).schema

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = sent.value
        for batch in batches:
            texts = batch["text"].tolist()
            for first, last, parts in trigram_runs(texts, plan.bits):
                sums = np.zeros((last - first, len(logs)))
                seen = np.zeros(last - first, np.int64)
                for hashed, owner in parts:
                    seen += np.bincount(owner, minlength=last - first)
                    for k, row in enumerate(logs):
                        sums[:, k] += np.bincount(owner, row[hashed], minlength=last - first)
                part = batch.iloc[first:last][keep].reset_index(drop=True)
                yield part.assign(likely=list(sums), trigrams=seen)

    return rows.mapInPandas(weigh, schema)


def host_levels(host: Column) -> Column:
    """A host, its last two labels and its last one, without repeats."""
    return F.array_distinct(
        F.array(host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1))
    )


def _log_table(counts: np.ndarray, added: float) -> np.ndarray:
    return np.log((counts + added) / (counts + added).sum(axis=-1, keepdims=True))


def _array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _plus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x + y)


def identify(
    docs: DataFrame,
    plan: Plan = Plan(),
    doc_id: str = "doc_id",
    text: str = "text",
    declared: str | None = "lang",
    host: str | None = "source",
    suffix: Column | None = None,
) -> DataFrame:
    """(doc_id, text_key, declared, text_language, language, probability, kept), one row
    for each document.

    ``language`` is the likeliest by all evidence, ``text_language`` by the text alone;
    both are null, and the document is not kept, where the text has no trigram of
    letters (so for null and empty texts). A document is kept if the posterior
    reaches ``least`` and the text fits its language. Ties go to the language that
    comes first in the plan, else by code. Where nothing is declared there is nothing
    to learn from: no text fits, and none is kept. Null or unknown declarations, hosts and suffixes count
    as no evidence. ``suffix``: the end of an address, such as a country's domain.
    Repeated rows count as often as they occur; an empty table gives an empty table;
    texts are read whole. text_key (xxhash64 of the text) tells rows of one id apart.

    Scale: what is collected has the size of the plan and of the languages there are,
    not of the data: trigram tables and the counts of declarations; suffixes and hosts stay distributed. A
    host's mix is joined by host and salt.
    """
    empty = F.lit(None).cast("string")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.lower(F.col(declared)).alias("declared") if declared else empty.alias("declared"),
        F.lower(F.col(host)).alias("host") if host else empty.alias("host"),
        (F.lower(suffix) if suffix is not None else empty).alias("suffix"),
        F.col(text).alias("text"),
    )
    found = plan.languages or declared_languages(rows, plan) or ("en",)
    languages = list(found)
    names = F.array(*[F.lit(x) for x in languages])
    table = learn(rows, languages, plan)
    weighed = stored(_text_evidence(rows, table, plan), "evidence")

    best = F.array_position("likely", F.array_max("likely")).cast("int") - 1
    seen = weighed.withColumn("best", F.when(F.col("trigrams") > 0, best))
    told = seen.filter(F.col("best").isNotNull())

    # Declarations: (language by text, declared) counts, of the plan's languages only.
    known = F.array_position(names, F.col("declared")).cast("int") - 1
    pairs = told.filter(F.col("declared").isin(languages)).groupBy("best", known.alias("d")).count()
    size = len(languages)
    confusion = np.zeros((size, size))
    for b, d, n in pairs.collect():
        confusion[b, d] = n
    by_declared = _log_table(confusion, 1.0).T
    whole = np.zeros(size)
    for b, n in told.groupBy("best").count().collect():
        whole[b] = n
    prior = (whole + 1) / (whole + 1).sum()

    score = F.transform("likely", lambda x: x * plan.weight)
    is_declared = F.col("declared").isin(languages)
    declared_part = F.get(F.array(*[_array(row) for row in by_declared]), known)
    score = F.when(is_declared, _plus(score, declared_part)).otherwise(score)
    fused = seen.withColumn("score", score)

    def counted(keys: DataFrame) -> DataFrame:
        """(key, counts): documents of each language."""
        each = [F.count(F.when(F.col("best") == b, 1)) for b in range(size)]
        return keys.filter("key is not null").groupBy("key").agg(F.array(*each).alias("counts"))

    def smoothed(up: Column) -> Column:
        """Shares of languages among a key's documents, pulled to those of ``up``."""
        total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) + plan.pull
        return F.zip_with("counts", up, lambda n, p: (n + plan.pull * p) / total)

    def looked_up(frame: DataFrame, key: Column, mixes: DataFrame, name: str) -> DataFrame:
        salts = 16
        dealt = frame.withColumn("_key", key).withColumn(
            "_salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)).cast("int")
        )
        copies = mixes.select(
            F.col("key").alias("_key"),
            F.col("mix").alias(name),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
        return dealt.join(copies, ["_key", "_salt"], "left").drop("_key", "_salt")

    # Hosts: the last label, then the last two, then the whole; each leans on the one before.
    own = counted(told.select(F.explode(host_levels(F.col("host"))).alias("key"), "best"))
    labels = F.least(F.size(F.split("key", "\\.")), F.lit(3))
    own = stored(own.withColumn("labels", labels), "hosts")
    mixes = own.filter("labels = 1").select("key", smoothed(_array(prior)).alias("mix"))
    every = mixes
    for k in (2, 3):
        up = mixes.select(F.col("key").alias("parent"), F.col("mix").alias("up"))
        parent = F.substring_index("key", ".", 1 - k)
        mixes = (
            own.filter(F.col("labels") == k)
            .withColumn("parent", parent)
            .join(up, "parent", "left")
            .select("key", smoothed(F.coalesce("up", _array(prior))).alias("mix"))
        )
        every = every.unionByName(mixes)
    if host:
        fused = looked_up(fused, F.col("host"), every, "host_mix")
        mix = F.coalesce("host_mix", _array(prior))
    else:
        mix = _array(prior)
    fused = fused.withColumn("score", _plus(F.col("score"), F.transform(mix, lambda p: F.log(p))))
    if suffix is not None:
        own = counted(told.select(F.col("suffix").alias("key"), "best"))
        shares = own.select("key", smoothed(_array(prior)).alias("mix"))
        fused = looked_up(fused, F.col("suffix"), shares, "suffix_mix")
        # P(suffix | language) as P(language | suffix) / P(language).
        ratio = F.zip_with("suffix_mix", _array(prior), lambda p, q: F.log(p / q))
        fused = fused.withColumn(
            "score",
            F.when(F.col("suffix_mix").isNull(), F.col("score")).otherwise(
                _plus(F.col("score"), ratio)
            ),
        )

    top = F.array_max("score")
    total = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    place = F.array_position("score", top).cast("int") - 1
    by_chance = -float(plan.bits) * float(np.log(2))
    fits = F.get("likely", F.col("place")) / F.col("trigrams") >= by_chance + plan.margin
    has_text = F.col("trigrams") > 0
    return (
        fused.withColumns({"place": place, "probability": F.when(has_text, 1 / total)})
        .select(
            "doc_id",
            "text_key",
            "declared",
            F.get(names, F.col("best")).alias("text_language"),
            F.when(has_text, F.get(names, F.col("place"))).alias("language"),
            "probability",
            F.coalesce(has_text & (F.col("probability") >= plan.least) & fits, F.lit(False)).alias(
                "kept"
            ),
        )
    )

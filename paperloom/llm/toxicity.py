"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings and ends, hashed. The machine
adds a weight for each term and, for each pair, the inner product of the two terms'
factors: so it learns what only goes together, such as an insult with the mention
of a group, which a sum of weights cannot express.

It is fitted on a bounded sample of the labelled rows. Of the hashed terms two kinds
take part: those whose documents' labels differ most from the rest, with value 1,
and the most frequent ones, as context, with values of length 1 together.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Memo, kept_in_worker, stored
from paperloom.llm.words import text_slices


class Plan(NamedTuple):
    """``labelled``: about how many labelled rows are fitted on, drawn by a hash of their
    ids. ``telling`` and ``frequent``: terms of the two kinds. ``least``: documents a
    term must occur in."""

    bits: int = 20
    labelled: int = 30_000
    telling: int = 8_192
    frequent: int = 1_024
    least: int = 3
    factors: int = 8
    rounds: int = 12
    batch: int = 128
    rate: float = 0.08
    shrink: float = 1e-4
    seed: int = 23


_WORDS = re.compile(r"\w+").findall
_WORD = re.compile(r"\w+").finditer
_ENDS = (4, 5, 6)
_WORDS_KEPT = 60_000
# Characters of texts whose terms are held together.
_SLICE_CHARS = 1_000_000
_WHOLE_CHARS = 2_000_000


def words_of(text: str | None) -> set[str]:
    """Distinct letters, digits and underscores in a row, lower-cased, of the whole text."""
    lowered = (text or "").lower()
    if len(lowered) > _WHOLE_CHARS:
        return {found.group() for found in _WORD(lowered)}
    return set(_WORDS(lowered))


def terms_of(word: str, bits: int) -> tuple[int, ...]:
    """Buckets of a word, and of its first and last 4 to 6 characters if it has more."""
    parts = [word]
    for n in _ENDS:
        if len(word) > n:
            parts += ["^" + word[:n], word[-n:] + "$"]
    shift = 64 - bits
    return tuple(xxhash.xxh3_64_intdigest(part.encode("utf-8", "replace")) >> shift for part in parts)


def buckets(text: str | None, known: dict[str, tuple[int, ...]]) -> set[int]:
    return set(chain.from_iterable(map(known.__getitem__, words_of(text))))


class Machine(NamedTuple):
    """``slot``: for each bucket its term's number, or -1. The first ``telling`` numbers are
    the telling terms."""

    bits: int
    slot: np.ndarray
    telling: int
    base: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of texts, given the numbers of their terms in a row."""
        values = values_of(flat, offsets, self.telling)
        return 1 / (1 + np.exp(-np.clip(self._raw(flat, offsets, values)[0], -500, 500)))

    def _raw(
        self, flat: np.ndarray, offsets: np.ndarray, values: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums of weights and pairs, factor sums of texts, factors times values). A pair's
        share is <f_i, f_j> x_i x_j; all pairs' is half of |sum|^2 - sum of squares."""
        scaled = self.factors[flat] * values[:, None]
        sums = _sums(scaled, offsets)
        squares = _sums((scaled * scaled).sum(axis=1), offsets)
        linear = _sums(self.weights[flat] * values, offsets)
        return self.base + linear + ((sums * sums).sum(axis=1) - squares) / 2, sums, scaled


def _sums(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; empty runs have 0."""
    total = np.zeros((len(offsets) - 1, *rows.shape[1:]))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        total[filled] = np.add.reduceat(rows, offsets[:-1][filled], axis=0)
    return total


def values_of(flat: np.ndarray, offsets: np.ndarray, telling: int) -> np.ndarray:
    """1 for telling terms; frequent ones of a text have the length 1 together."""
    context = flat >= telling
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    count = np.bincount(owner[context], minlength=len(offsets) - 1)
    return np.where(context, 1 / np.sqrt(np.maximum(count, 1))[owner], 1.0)


def fit(
    flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray, machine: Machine, plan: Plan
) -> Machine:
    """Weights and factors by gradient steps on batches of rows, each entry's step by the
    squares of its gradients so far. Deterministic for a given order of rows."""
    draw = np.random.default_rng(plan.seed)
    terms = len(machine.weights)
    weights, base = np.zeros(terms), machine.base
    factors = draw.normal(0, 0.05, (terms, plan.factors))
    seen_w, seen_f, seen_b = np.full(terms, 1e-2), np.full(factors.shape, 1e-2), 1.0
    rows = len(labels)
    lengths = np.diff(offsets)
    values = values_of(flat, offsets, machine.telling)
    for _ in range(plan.rounds if rows else 0):
        order = draw.permutation(rows)
        for start in range(0, rows, plan.batch):
            chosen = order[start : start + plan.batch]
            size = lengths[chosen]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(offsets[chosen] - ends[:-1], size) + np.arange(ends[-1])
            ids, x = flat[at], values[at]
            now = machine._replace(base=base, weights=weights, factors=factors)
            raw, sums, scaled = now._raw(ids, ends, x)
            error = 1 / (1 + np.exp(-np.clip(raw, -500, 500))) - labels[chosen]
            owner = np.repeat(np.arange(len(chosen)), size)
            pull = error[owner] * x
            used, place = np.unique(ids, return_inverse=True)
            step_w = np.bincount(place, pull, minlength=len(used)) / plan.batch
            step_w += plan.shrink * weights[used]
            by_entry = pull[:, None] * (sums[owner] - scaled)
            step_f = plan.shrink * factors[used]
            for k, column in enumerate(by_entry.T):
                step_f[:, k] += np.bincount(place, column, minlength=len(used)) / plan.batch
            seen_w[used] += step_w**2
            weights[used] -= plan.rate * step_w / np.sqrt(seen_w[used])
            seen_f[used] += step_f**2
            factors[used] -= plan.rate * step_f / np.sqrt(seen_f[used])
            step_b = error.mean()
            seen_b += step_b**2
            base -= plan.rate * step_b / np.sqrt(seen_b)
    return machine._replace(base=float(base), weights=weights, factors=factors)


def _known(bits: int) -> Memo:
    make = lambda: Memo(lambda word: terms_of(word, bits), _WORDS_KEPT)
    return kept_in_worker(("toxic terms", bits), make)


def _sample_terms(docs: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, toxic, terms) of the rows to fit on. The sample's ids and labels, whose
    number is bounded, go to all tasks; texts stay where they are."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    one = one.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = one.count()
    most = 1 << 30
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(plan.seed)), F.lit(most))
    share = min(most, most * plan.labelled // max(total, 1))
    some = one.filter(drawn < share)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(plan.bits)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in text_slices(texts, _SLICE_CHARS):
                found = [_sorted(buckets(text, known), np.int32) for text in texts[first:last]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("toxic").slice(first, last - first),
                        pa.array(found, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "toxic", "terms"],
                )

    found = rows.select("doc_id", "toxic", "text").mapInArrow(
        find, "doc_id long, toxic int, terms array<int>"
    )
    return stored(found, "toxic-terms")


def _counts(sample: DataFrame, plan: Plan) -> np.ndarray:
    """(label, bucket): documents of the sample. Summed in each task, then by bucket; the
    plan fixes how many there are."""
    size = 1 << plan.bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for toxic, terms in zip(batch["toxic"], batch["terms"]):
                total[int(toxic > 0), terms] += 1
        bucket = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": bucket, "clean": total[0, bucket], "toxic": total[1, bucket]})

    summed = (
        sample.select("toxic", "terms")
        .mapInPandas(count, "bucket int, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= plan.least)
    )
    out = np.zeros((2, size), np.int64)
    found = summed.toPandas()
    out[:, found["bucket"]] = found[["clean", "toxic"]].to_numpy().T
    return out


def _chosen(counts: np.ndarray, rows: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(telling, frequent) buckets, given documents of each label with and in all."""
    both = counts.sum(axis=0)
    share = rows[1] / max(rows.sum(), 1)
    spread = np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    apart = np.where(both > 0, np.abs(counts[1] - both * share) / spread, 0.0)
    order = np.lexsort((np.arange(len(both)), -apart))[: plan.telling]
    telling = order[apart[order] > 0]
    left = both.copy()
    left[telling] = 0
    order = np.lexsort((np.arange(len(both)), -left))[: plan.frequent]
    return telling, order[left[order] > 0]


def learn(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> Machine:
    """The machine, from documents (doc_id, text) and their labels (doc_id, toxic).

    An id of several labels is toxic if one of them is; null ids, labels and texts are
    not learned from. Without any label every score is the same, below 0.1. What the
    driver holds is bounded by the plan: counts of buckets and, of the sampled rows, the
    numbers of chosen terms.
    """
    sample = _sample_terms(docs, labels, plan)
    rows = np.zeros(2, np.int64)
    for row in sample.groupBy((F.col("toxic") > 0).cast("int").alias("of")).count().collect():
        rows[row["of"]] = row["count"]
    telling, frequent = _chosen(_counts(sample, plan), rows, plan)
    terms = np.concatenate([telling, frequent])
    slot = np.full(1 << plan.bits, -1, np.int32)
    slot[terms] = np.arange(len(terms), dtype=np.int32)
    sent = sample.sparkSession.sparkContext.broadcast(slot)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("terms")
            numbers = [sent.value[np.asarray(one.as_py(), np.int64)] for one in column]
            kept = [one[one >= 0] for one in numbers]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.array(kept, pa.list_(pa.int32())),
                ],
                names=["doc_id", "toxic", "terms"],
            )

    chosen = sample.mapInArrow(choose, "doc_id long, toxic int, terms array<int>").toArrow()
    offsets, flat = _flat(chosen.column("terms").combine_chunks())
    labelled = (chosen.column("toxic").to_numpy() > 0).astype(np.float64)
    order = np.lexsort((_row_keys(flat, offsets), chosen.column("doc_id").to_numpy()))
    lengths = np.diff(offsets)[order]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(offsets[:-1][order] - ends[:-1], lengths) + np.arange(ends[-1])
    share = (rows[1] + 0.1) / (rows.sum() + 1.2)
    empty = Machine(
        plan.bits,
        slot,
        len(telling),
        float(np.log(share / (1 - share))),
        np.zeros(len(terms)),
        np.zeros((len(terms), plan.factors)),
    )
    return fit(flat[at].astype(np.int64), ends, labelled[order], empty, plan)


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    parts = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    lengths = [np.diff(part.offsets.to_numpy()) for part in parts]
    values = [part.flatten().to_numpy() for part in parts]
    sizes = np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)
    return (
        np.concatenate([[0], np.cumsum(sizes)]),
        np.concatenate([np.zeros(0, np.int32), *values]),
    )


def _row_keys(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number of each row's terms, to order rows of one id alike in every run."""
    weights = (flat.astype(np.float64) + 1) * 0.6180339887498949 % 1
    return _sums(np.floor(weights * 2**30), offsets)


def score_documents(
    docs: DataFrame, machine: Machine, text: str = "text", score: str = "score"
) -> DataFrame:
    """The documents without their text, with ``score``: the probability, from 0 to 1, that a
    text is toxic. Scores depend on the text alone.

    Null and empty texts have the score of a text without known terms. Texts are read
    whole; repeated rows score alike; an empty table gives an empty table; columns other
    than the text and one named ``score`` stay as they are. Nothing is shuffled.
    """
    keep = [name for name in docs.columns if name not in (text, score)]
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    key = ("toxic slots", uuid.uuid4().hex)
    schema = docs.select(*keep, F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value

        def slots(word: str) -> tuple[int, ...]:
            found = (int(model.slot[b]) for b in terms_of(word, model.bits))
            return tuple(n for n in found if n >= 0)

        known = kept_in_worker(key, lambda: Memo(slots, _WORDS_KEPT))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for first, last in text_slices(texts, _SLICE_CHARS):
                found = [_sorted(buckets(text, known)) for text in texts[first:last]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.int64), *found])
                columns = [batch.column(name).slice(first, last - first) for name in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(model.scores(flat, offsets))], names=[*keep, score]
                )

    return docs.mapInArrow(run, schema)


def _sorted(numbers: Iterable[int], kind: type = np.int64) -> np.ndarray:
    return np.array(sorted(numbers), kind)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts

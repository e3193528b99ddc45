"""Language-model scoring by a weighted backoff automaton.

Counts of all n-grams of the training texts smooth each other: a history seen c
times lends the share ``discount * c ** -fall`` to the next shorter history. The
automaton's states are the histories that were seen, its arcs the n-grams, with
their smoothed log-probability; from a state without an arc for a word a failure
arc leads to the next shorter history at the price of the share lent. One pass
from left to right carries the state and adds up the weights.

The model grows with the corpus and is nowhere held whole. Texts are dealt into
blocks. A block sends its distinct n-grams, as sorted hashes, to the parts of the
key space; a part counts them over all blocks and answers each block in the
block's own order, so an answer is little more than a byte an n-gram. Texts go to their blocks
in compressed packs, one for each block and batch. A block then
builds the part of the automaton that its texts can reach, which gives the same
scores as the whole would. A frequent word is one key of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from array import array
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import blocks_of
from paperloom.llm.words import mixed, word_hashes


class Plan(NamedTuple):
    """``discount`` and ``fall`` by order from 2 on. Keys of single words have 64 bits,
    those of longer n-grams ``key_bits``. The shares were chosen by the likelihood of
    held-out texts at sf0.1."""

    order: int = 3
    discount: tuple[float, ...] = (0.95, 0.5)
    fall: tuple[float, ...] = (0.05, 0.0)
    added: float = 0.1
    key_bits: int = 56
    block_chars: int = 4_000_000
    part_words: int = 1_500_000


START = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0xD1B54A32D192ED03)
_CHARS_A_WORD = 6


def _bytes_of(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; planes of zeros cost nothing."""
    wide = values.astype("<u8")
    width = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _values_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = planes.reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _ascending(keys: np.ndarray) -> bytes:
    return _bytes_of(np.diff(keys, prepend=np.uint64(0)))


class _Grams(NamedTuple):
    """The n-grams of a block's texts. Each text is START, its words, END; ``word_at``
    marks places that are predicted. Per order: sorted distinct keys, and for each
    place the index of the n-gram ending there, -1 where it would begin before START."""

    lengths: np.ndarray
    word_at: np.ndarray
    keys: list[np.ndarray]
    index: list[np.ndarray]


def _grams(texts: list[str], plan: Plan) -> _Grams:
    hashes, offsets = word_hashes(texts)
    lengths = np.diff(offsets) + 2
    total = int(lengths.sum())
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    row = np.empty(total, np.uint64)
    inner = np.ones(total, bool)
    inner[starts] = inner[ends] = False
    row[inner] = mixed(hashes)
    row[starts], row[ends] = START, END
    place = np.arange(total) - np.repeat(starts, lengths)
    mask = np.uint64((1 << plan.key_bits) - 1)
    keys, index = [], []
    chained = row
    for n in range(1, plan.order + 1):
        if n > 1:
            before = np.concatenate([[START], chained[:-1]])
            chained = mixed(mixed(before + np.uint64(n)) + row)
        whole = place >= n - 1
        some, inverse = np.unique(chained[whole] & mask if n > 1 else row, return_inverse=True)
        at = np.full(total, -1, np.int64)
        at[whole] = inverse
        keys.append(some)
        index.append(at)
    word_at = np.ones(total, bool)
    word_at[starts] = False
    return _Grams(lengths, word_at, keys, index)


def _bounds(order: int, parts: int, plan: Plan) -> np.ndarray:
    """First keys of the parts after the first."""
    bits = 64 if order == 1 else plan.key_bits
    return np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)


def _packed(rows: DataFrame) -> DataFrame:
    """(block, texts, held_out, doc_id): for each batch and block the texts as one
    compressed run with their lengths in bytes, and the other columns as lists."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            out = []
            for block, part in batch.groupby("block"):
                texts = [text.encode("utf-8", "replace") for text in part["text"]]
                out.append(
                    (
                        block,
                        packer.compress(b"".join(texts)),
                        [len(text) for text in texts],
                        part["held_out"].tolist(),
                        part["doc_id"].astype(object).where(part["doc_id"].notna(), None).tolist(),
                    )
                )
            yield pd.DataFrame(out, columns=["block", "texts", "sizes", "held_out", "doc_id"])

    return rows.mapInPandas(
        pack,
        "block int, texts binary, sizes array<int>, held_out array<boolean>, "
        f"doc_id array<{kind}>",
    )


def _unpacked(packs: pd.DataFrame) -> pd.DataFrame:
    """The rows (doc_id, held_out, text) of a block's packs."""
    opener = zstandard.ZstdDecompressor()
    ids, held, texts = [], [], []
    for blob, sizes, own, doc_ids in zip(
        packs["texts"], packs["sizes"], packs["held_out"], packs["doc_id"]
    ):
        plain, at = opener.decompress(blob), 0
        for size in sizes:
            texts.append(plain[at : at + size].decode())
            at += size
        held.extend(bool(x) for x in own)
        ids.extend(doc_ids)
    return pd.DataFrame(
        {"doc_id": pd.Series(ids, dtype=object), "held_out": held, "text": texts}
    )


def _requests(docs: DataFrame, parts: int, plan: Plan) -> DataFrame:
    def request(packs: pd.DataFrame) -> pd.DataFrame:
        block = _unpacked(packs)
        grams = _grams(block["text"].tolist(), plan)
        train = np.repeat(~block["held_out"].to_numpy(bool), grams.lengths)
        rows = []
        for n in range(1, plan.order + 1):
            keys, at = grams.keys[n - 1], grams.index[n - 1]
            counts = np.bincount(at[train & (at >= 0)], minlength=len(keys))
            cuts = [0, *np.searchsorted(keys, _bounds(n, parts, plan)), len(keys)]
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b or n == 1:  # parts of single words tell every block their totals
                    rows.append((n, part, _ascending(keys[a:b]), _bytes_of(counts[a:b])))
        out = pd.DataFrame(rows, columns=["n", "part", "keys", "counts"])
        out["block"] = packs["block"].iloc[0]
        return out

    return docs.groupBy("block").applyInPandas(
        request, "n int, part int, keys binary, counts binary, block int"
    )


def _answers(requests: DataFrame) -> DataFrame:
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(_values_of(data), dtype=np.uint64) for data in rows["keys"]]
        counts = np.concatenate([_values_of(data) for data in rows["counts"]])
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        words = totals[keys != START]
        return pd.DataFrame(
            {
                "block": rows["block"],
                "n": rows["n"],
                "part": rows["part"],
                "totals": [_bytes_of(totals[i]) for i in np.split(inverse, cuts)],
                "part_tokens": int(words.sum()),
                "part_types": int((words > 0).sum()),
            }
        )

    return requests.groupBy("n", "part").applyInPandas(
        answer,
        "block int, n int, part int, totals binary, part_tokens long, part_types long",
    )


def _doubles(values: np.ndarray) -> array:
    return array("d", np.ascontiguousarray(values, np.float64).tobytes())


def _longs(values: np.ndarray) -> array:
    return array("q", np.ascontiguousarray(values, np.int64).tobytes())


class Automaton:
    """States: 0 is the empty history, then the histories of one word, of two and so on,
    each by its index among the block's n-grams. Arcs are numbered the same way.
    ``arc_at[n]`` has, for each place of the block's texts, the arc that leads there
    from a state of n words, -1 if there is none; so no table of arcs is searched."""

    def __init__(
        self, grams: _Grams, counts: list[np.ndarray], tokens: int, types: int, plan: Plan
    ):
        self.longest = plan.order - 1
        words = np.arange(len(grams.keys[0]))
        share = (counts[0] + plan.added) / (tokens + plan.added * (types + 1))
        self.base = np.log10(share)
        weights, targets = [self.base], [np.where(counts[0] > 0, words + 1, 0)]
        fail_weights, fail_targets = [np.zeros(1)], [np.zeros(1, np.int64)]
        self.arc_at = [grams.index[0]]
        arcs, first, back = len(words), 1, np.zeros(len(words), np.int64)
        for n in range(2, plan.order + 1):
            at, under = grams.index[n - 1], grams.index[n - 2]
            # The n-grams' histories and suffixes, each from one place.
            place = np.zeros(len(grams.keys[n - 1]), np.int64)
            place[at[at >= 0]] = np.flatnonzero(at >= 0)
            history, suffix = under[place - 1], under[place]
            seen, own = counts[n - 2], counts[n - 1]
            lent = plan.discount[n - 2] * np.maximum(seen, 1.0) ** -plan.fall[n - 2]
            fail_weights.append(np.log10(lent))
            fail_targets.append(back)
            part = (1 - lent[history]) * own / np.maximum(seen[history], 1)
            share = np.where(
                seen[history] > 0, part + lent[history] * share[suffix], share[suffix]
            )
            weights.append(np.log10(share))
            back = np.where(seen[suffix] > 0, first + suffix, 0)
            if n < plan.order:
                first += len(seen)
                targets.append(first + np.arange(len(own)))
            else:
                targets.append(first + suffix)
            self.arc_at.append(
                np.where((at >= 0) & (own[np.maximum(at, 0)] > 0), arcs + at, -1)
                if len(own)
                else at
            )
            arcs += len(own)
        if not self.longest:
            targets = [np.zeros(len(words), np.int64)]
        self.weight = _doubles(np.concatenate(weights))
        self.target = _longs(np.concatenate(targets))
        self.fail_weight = _doubles(np.concatenate(fail_weights))
        self.fail_target = _longs(np.concatenate(fail_targets))

    def score(self, start: int, first: int, last: int) -> float:
        """Log10-probability of the words from place ``first`` to before ``last``, read from
        left to right from the state ``start``."""
        weight, target, longest = self.weight, self.target, self.longest
        fail_weight, fail_target = self.fail_weight, self.fail_target
        state, length, total = start, int(start > 0), 0.0
        for arcs in zip(*[at[first:last].tolist() for at in self.arc_at]):
            arc = arcs[length]
            while arc < 0:
                total += fail_weight[state]
                state = fail_target[state]
                length -= 1
                arc = arcs[length]
            total += weight[arc]
            state = target[arc]
            length = min(length + 1, longest) if state else 0
        return total


def score_documents(
    docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.

    A document is held out of training if crc32 of its id as text is divisible by 10;
    a null id counts as empty text, whose crc32 is 0. Tokens are the words, A-Z
    lower-cased, and one end. A null or empty text is the end alone. Repeated rows
    count as often as they occur; an empty table gives an empty table; texts are
    read whole, the longest in one block. Without training tokens all tokens are
    unknown. Only the two named columns are read.
    """
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    size = F.length("text") + _CHARS_A_WORD
    blocks = max(blocks_of(plain, size, plan.block_chars), 2)
    parts = -(-blocks * plan.block_chars // (_CHARS_A_WORD * plan.part_words))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    placed = plain.select(
        "doc_id", "text", (crc % 10 == 0).alias("held_out"), block.alias("block")
    )
    dealt = _packed(placed).repartition(blocks, "block")
    answers = _answers(_requests(dealt, parts, plan))

    def score(packs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        texts = _unpacked(packs)
        grams = _grams(texts["text"].tolist(), plan)
        found = found.sort_values(["n", "part"])
        counts = [
            np.concatenate([_values_of(x) for x in found.loc[found["n"] == n, "totals"]]).astype(
                np.int64
            )
            for n in range(1, plan.order + 1)
            if len(grams.keys[n - 1]) or n == 1
        ]
        counts += [np.zeros(0, np.int64)] * (plan.order - len(counts))
        single = found[found["n"] == 1]
        tokens, types = int(single["part_tokens"].sum()), int(single["part_types"].sum())
        automaton = Automaton(grams, counts, tokens, types, plan)
        words = grams.index[0]
        cuts = np.cumsum(grams.lengths)
        first = int(np.searchsorted(grams.keys[0], START))
        begin = first + 1 if plan.order > 1 and counts[0][first] > 0 else 0
        starts = cuts - grams.lengths
        base = np.add.reduceat(np.where(grams.word_at, automaton.base[words], 0.0), starts)
        is_known = grams.word_at & (counts[0][words] > 0)
        known = np.add.reduceat(is_known, starts, dtype=np.int64)
        scores = [
            automaton.score(begin, a + 1, b) for a, b in zip(starts.tolist(), cuts.tolist())
        ]
        return pd.DataFrame(
            {
                "doc_id": texts["doc_id"].to_numpy(),
                "held_out": texts["held_out"].to_numpy(),
                "n_tokens": grams.lengths - 1,
                "n_known": known,
                "train_tokens": tokens,
                "base_score": base,
                "score": scores,
            }
        )

    kind = plain.schema["doc_id"].dataType.simpleString()
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(
            score,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
            "train_tokens long, base_score double, score double",
        )
    )

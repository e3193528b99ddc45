"""Benchmark decontamination under edits of words.

Runs of words of a document, each as long as a benchmark item, and the items are
embedded by CGK random walks: a walk copies symbols and stays or steps on by a hash
of place and symbol, so that two rows a few edits apart fall into step again and
differ in few places. Samples of the places are hashed; a run that shares a sample
with an item is a candidate. Several walks with several samples each reach the
target recall. Candidates are verified by their exact edit distance.

A run within e edits of an item of n words has at least n - e words of the items'
vocabulary, and holds some n / (e + 1) words of the item in a row as they are: three
at least, where a fifth of eight words or more is edited. Only runs with both are
embedded; nothing within reach is lost by that.

Items of fewer words would match by chance within a text; they count where they are,
word for word, one or more whole lines or sentences.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import blocks_of, stored
from paperloom.llm.words import mixed, text_slices


class Plan(NamedTuple):
    """Edits up to ``share`` of an item's words count as the item. Items of fewer than
    ``fewest`` words are looked for as whole lines or sentences only. With 12 walks of
    8 samples of 4 places, runs with the most edits allowed are found in more than 95
    of 100 cases, those with fewer more surely, and exact ones always."""

    share: float = 0.2
    fewest: int = 8
    walks: int = 12
    samples: int = 8
    places: int = 4
    seed: int = 3
    item_chars: int = 8_000_000


_WORDS = re.compile(r"\w+").findall
_STOPS = re.compile(r"[\n.!?]+").split
_RUNS_AT_ONCE = 4_096


def words_of(text: str | None) -> list[str]:
    """Letters, digits and underscores in a row, lower-cased."""
    return _WORDS((text or "").lower())


def embedded(rows: np.ndarray, walks: int, seed: int) -> np.ndarray:
    """CGK embeddings (row, walk, place) of rows of n symbols; places are 3 n and symbols
    beyond the end are 0."""
    count, n = rows.shape
    padded = np.concatenate([rows, np.zeros((count, 1), rows.dtype)], axis=1)
    at = np.zeros((count, walks), np.int64)
    out = np.empty((count, walks, 3 * n), np.uint64)
    line = np.arange(count)[:, None]
    salts = mixed(np.arange(1, walks + 1, dtype=np.uint64) + np.uint64(seed << 32))
    for j in range(3 * n):
        symbol = padded[line, at]
        out[:, :, j] = symbol
        step = mixed(symbol + salts + np.uint64(j << 40)) >> np.uint64(63)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


def keys_of(rows: np.ndarray, plan: Plan) -> np.ndarray:
    """(row, walk x sample): hashes of sampled places of the embeddings."""
    n = rows.shape[1]
    walked = embedded(rows, plan.walks, plan.seed)
    draw = np.random.default_rng([plan.seed, n])
    chosen = draw.integers(0, 3 * n, (plan.walks, plan.samples, plan.places))
    keys = np.zeros((len(rows), plan.walks, plan.samples), np.uint64)
    for k in range(plan.places):
        picked = np.stack([walked[:, w, chosen[w, :, k]] for w in range(plan.walks)], axis=1)
        keys = mixed(keys + picked)
    ids = np.arange(plan.walks * plan.samples, dtype=np.uint64) + np.uint64(n << 32)
    return mixed(keys.reshape(len(rows), -1) + mixed(ids))


class _Item(NamedTuple):
    item_id: int
    words: list[str]
    edits: int
    masks: dict[str, int]


def distance_within(item: _Item, words: list[str]) -> int:
    """Least number of edits between the item and any run of the given words: one bit a
    word of the item, one step a word of the text."""
    n = len(item.words)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    get = item.masks.get
    for word in words:
        equal = get(word, 0)
        across = equal | minus
        down = (((equal & plus) + plus) ^ plus) | equal
        more = minus | ~(down | plus) & full
        less = plus & down
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = (more << 1) & full
        less = (less << 1) & full
        plus = less | ~(across | more) & full
        minus = more & across
        best = min(best, score)
    return best


class Items:
    """Benchmark items with their vocabulary and sampled hashes."""

    def __init__(self, rows: list[tuple[int, str | None]], plan: Plan):
        self.plan = plan
        self.items: list[_Item] = []
        self.vocabulary: dict[str, int] = {}
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item_id, text in rows:
            words = words_of(text)
            if len(words) < plan.fewest:
                if words:
                    self.short[tuple(words)].append(item_id)
                continue
            masks: dict[str, int] = {}
            for i, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << i
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            self.items.append(_Item(item_id, words, int(plan.share * len(words)), masks))
        by_length = defaultdict(list)
        for i, item in enumerate(self.items):
            by_length[len(item.words)].append(i)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unedited: dict[int, np.ndarray] = {}
        for n, members in by_length.items():
            symbols = np.array(
                [[self.vocabulary[w] for w in self.items[i].words] for i in members], np.uint64
            )
            if n // (int(plan.share * n) + 1) < 3:
                raise ValueError("more edits than leave three words in a row")
            self.unedited[n] = np.unique(np.concatenate([self._rows(x) for x in symbols]))
            keys = keys_of(symbols, plan)
            owner = np.repeat(members, keys.shape[1])
            order = np.argsort(keys.reshape(-1), kind="stable")
            self.tables[n] = keys.reshape(-1)[order], owner[order]
        self.longest = max(by_length, default=0)

    def _rows(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of three symbols in a row, from each place; equal rows have equal ones."""
        base = np.uint64(len(self.vocabulary) + 1)
        return (symbols[:-2] * base + symbols[1:-1]) * base + symbols[2:]

    def _candidates(self, symbols: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) of runs that share a sample with an item."""
        known = symbols > 0
        within = np.concatenate([[0], np.cumsum(known)])
        place = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        rows = self._rows(symbols)[place]
        for n, (keys, owner) in self.tables.items():
            if len(symbols) < n:
                continue
            same = place[np.isin(rows, self.unedited[n])]
            starts = np.unique(same[:, None] - np.arange(n - 2))
            starts = starts[(starts >= 0) & (starts + n <= len(symbols))]
            inside = within[starts + n] - within[starts]
            starts = starts[inside >= n - int(self.plan.share * n)]
            for k in range(0, len(starts), _RUNS_AT_ONCE):
                some = starts[k : k + _RUNS_AT_ONCE]
                asked = keys_of(symbols[some[:, None] + np.arange(n)], self.plan)
                low = np.searchsorted(keys, asked)
                high = np.searchsorted(keys, asked, "right")
                pairs = set()
                for row, column in zip(*np.nonzero(high > low)):
                    for i in owner[low[row, column] : high[row, column]].tolist():
                        pairs.add((int(some[row]), i))
                yield from pairs

    def _whole(self, text: str | None) -> set[int]:
        """Short items that are one or more whole lines or sentences of a text."""
        found: set[int] = set()
        parts = [words for one in _STOPS(text or "") if (words := words_of(one))]
        for first in range(len(parts)):
            row: list[str] = []
            for words in parts[first:]:
                row += words
                if len(row) >= self.plan.fewest:
                    break
                found.update(self.short.get(tuple(row), ()))
        return found

    def found(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """(item_id, distance) of the items in each text."""
        words = [words_of(text) for text in texts]
        # Texts in one row, parted by symbols that no item has.
        gap = self.longest
        starts = np.cumsum([gap] + [len(w) + gap for w in words])
        symbols = np.zeros(int(starts[-1]), np.uint64)
        get = self.vocabulary.get
        for start, row in zip(starts, words):
            symbols[start : start + len(row)] = [get(w, 0) for w in row]
        # Runs about an item lie next to each other: their surroundings are looked at once.
        around: dict[tuple[int, int], list[int]] = defaultdict(list)
        for place, i in self._candidates(symbols):
            first = int(np.searchsorted(starts, place, "right")) - 1
            # A run may begin before a text, in the gap, and reach into it.
            for t in {max(first, 0), min(first + 1, len(texts) - 1)}:
                around[t, i].append(place - int(starts[t]))
        nearest: list[dict[int, int]] = [{} for _ in texts]
        for (t, i), places in around.items():
            item = self.items[i]
            n, slack = len(item.words), item.edits
            for a, b in _merged([(p - slack, p + n + slack) for p in sorted(places)]):
                distance = distance_within(item, words[t][max(a, 0) : max(b, 0)])
                if distance <= item.edits and distance < nearest[t].get(i, n):
                    nearest[t][i] = distance
        out = [{(self.items[i].item_id, d) for i, d in x.items()} for x in nearest]
        if self.short:
            for text, found in zip(texts, out):
                found.update((item_id, 0) for item_id in self._whole(text))
        return [sorted(found) for found in out]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    plan: Plan = Plan(),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    leaks: str = "leaks",
) -> DataFrame:
    """The documents with one more column: array<struct<item_id, distance>> of the items
    each holds within the edits allowed, distance in words (an existing column of the
    name is replaced).

    Null and empty texts hold nothing; null items, those without words and items of a
    null id are not looked for; items of few words count as whole lines or sentences; an item that occurs several times counts with its least distance,
    repeated items once each id. Empty tables give empty lists. Texts are read whole,
    nothing is shuffled. Items are sent to the tasks in parts of bounded size; for more
    than one part the documents are stored in between, so a task holds one part.
    """
    named = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    named = named.filter("i is not null and t is not null").distinct()
    parts = blocks_of(named, F.length("t"), plan.item_chars)
    found = docs.withColumn(leaks, F.lit(None).cast("array<struct<item_id:long,distance:int>>"))
    found = found.withColumn(leaks, F.coalesce(leaks, F.array().cast(found.schema[leaks].dataType)))
    for part in range(parts):
        rows = named.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        found = _with_leaks(found, [tuple(r) for r in rows], plan, text, leaks)
        if part + 1 < parts:
            found = stored(found, "leaks")
    return found


def _with_leaks(
    docs: DataFrame, rows: list[tuple[int, str]], plan: Plan, text: str, leaks: str
) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, plan)
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            for first, last in text_slices(texts):
                part = batch.slice(first, last - first)
                before = part.column(names.index(leaks)).to_pylist()
                now = []
                for old, new in zip(before, items.found(texts[first:last])):
                    least = {x["item_id"]: x["distance"] for x in old}
                    for i, distance in new:
                        least[i] = min(distance, least.get(i, distance))
                    now.append(
                        [{"item_id": i, "distance": d} for i, d in sorted(least.items())]
                    )
                kind = batch.schema.field(leaks).type
                columns = [
                    pa.array(now, kind) if name == leaks else part.column(k)
                    for k, name in enumerate(names)
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(search, docs.schema)

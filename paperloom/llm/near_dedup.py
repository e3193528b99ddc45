"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Every text gets minima of many hash functions over its word shingles. Bands of
them make buckets, in which candidates meet. For the estimate, the minima of the
parts of one hash's range are kept, of each only the low bits, packed; equal lanes
are counted by bit operations and corrected for chance. Pairs that the estimate
leaves open are confirmed on the full sets.

Texts with the same set are one class and take part once. In a bucket, first every
class is compared with one hub only. Where a bucket then still has members of
several components, all plausible pairs of different components are compared on their
sets, in the first bucket that a pair shares. Pairs live in a task's arrays only: a cell
of a bucket hands on links that join components within it, fewer than it has members.
So no link that could join two components is left out, while neither pairs inside a
component nor pairs that come close to the threshold, of which there may be very
many, are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored
from paperloom.llm.components import connected
from paperloom.llm.words import mixed, shingles, text_slices, word_hashes


class Plan(NamedTuple):
    """Parameters. With 32 bands of 5 a pair of similarity 0.8 is missed 3 times in a
    million; ``slack`` is four and a half deviations of the estimate from 512 lanes.
    A cell holds at most about ``cell`` members, or members of ``items`` shingles, a side."""

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    lanes: int = 512
    bits: int = 4
    slack: float = 0.085
    cell: int = 1_000
    items: int = 2_000_000
    seed: int = 11


# Characters of texts that are hashed together.
_SLICE_CHARS = 1_000_000


def _functions(plan: Plan) -> np.ndarray:
    draw = np.random.default_rng(plan.seed)
    count = plan.bands * plan.rows
    return draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the items, in blocks of bounded size. A function
    multiplies by an odd factor, which permutes the values of well mixed items."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        hashed = np.multiply.outer(factors, short[k : k + 1024])
        np.minimum(least, hashed.min(axis=1), out=least)
    return mixed(least.astype(np.uint64))


def packed(items: np.ndarray, lanes: int, bits: int) -> bytes:
    """The low bits, from 1 up, of the least item of each of ``lanes`` equal parts of the
    range, 0 where a part has none, packed into whole 64-bit words. Items are sorted,
    so a part's first one is its least."""
    part = (items >> np.uint64(64 - lanes.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    kept = np.zeros(lanes, np.uint8)
    kept[part[first]] = 1 + mixed(items[first]) % np.uint64((1 << bits) - 1)
    wide = np.unpackbits(kept[:, None], axis=1)[:, 8 - bits :].reshape(-1)
    return np.packbits(wide).tobytes()


def similarity(left: np.ndarray, right: np.ndarray, lanes: int, bits: int) -> np.ndarray:
    """Estimated similarity of packed signatures (last axis: 64-bit words): the share of
    equal lanes among those that are not empty on both sides, less what lanes filled
    on both sides agree in by chance."""
    ones = np.uint64(sum(1 << (k * bits) for k in range(64 // bits)))

    def count(words: np.ndarray) -> np.ndarray:
        folded = words.copy()
        for k in range(1, bits):
            folded |= words >> np.uint64(k)
        return np.bitwise_count(folded & ones).sum(axis=-1, dtype=np.int64)

    filled = np.maximum(count(left | right), 1)
    in_both = count(left) + count(right) - filled
    equal = filled - count(left ^ right)
    chance = 1 / ((1 << bits) - 1)  # of two lanes with different items
    return (equal - in_both * chance) / (1 - chance) / filled


def _words_of(signatures: pd.Series) -> np.ndarray:
    if not len(signatures):
        return np.zeros((0, 1), np.uint64)
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)


def _signed(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, signature, buckets); node: digest of the set,
    null without words."""
    import hashlib

    factors = _functions(plan)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for first, last in text_slices(texts, _SLICE_CHARS):
                hashes, offsets = word_hashes(texts[first:last])
                rows = []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    items = shingles(hashes[a:b], plan.width)
                    if not len(items):
                        rows.append((0, None, None, None))
                        continue
                    least = minima(items, factors)
                    keys = least.reshape(plan.bands, plan.rows)
                    mixed_keys = np.arange(plan.bands, dtype=np.uint64)
                    for k in range(plan.rows):
                        mixed_keys = mixed(mixed_keys + keys[:, k])
                    rows.append(
                        (
                            len(items),
                            hashlib.blake2b(items.tobytes(), digest_size=16).digest(),
                            packed(items, plan.lanes, plan.bits),
                            mixed_keys.view(np.int64),
                        )
                    )
                part = batch.iloc[first:last]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "text_key": part["text_key"].to_numpy(),
                        "n_shingles": [r[0] for r in rows],
                        "node": [r[1] for r in rows],
                        "signature": [r[2] for r in rows],
                        "buckets": [r[3] for r in rows],
                    }
                )

    return docs.mapInPandas(
        sign,
        "doc_id long, text_key long, n_shingles long, node binary, signature binary, "
        "buckets array<long>",
    )


def _shingle_sets(texts: DataFrame, plan: Plan) -> DataFrame:
    """(node, items) of (node, text): sorted hashes of the shingles."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch["text"].tolist()
            for first, last in text_slices(found, _SLICE_CHARS):
                hashes, offsets = word_hashes(found[first:last])
                sets = [
                    shingles(hashes[a:b], plan.width).tobytes()
                    for a, b in zip(offsets[:-1], offsets[1:])
                ]
                yield pd.DataFrame({"node": batch["node"].iloc[first:last].to_numpy(), "items": sets})

    return texts.mapInPandas(cut, "node binary, items binary")


def _shared(items: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many items each of the other sets has in common with one."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.searchsorted(items, flat)
    at[at == len(items)] = 0
    return np.add.reduceat(items[at] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)


def _linked(items: np.ndarray, others: list[np.ndarray], plan: Plan) -> np.ndarray:
    """Which of the other sets are similar enough; no set is empty."""
    shared = _shared(items, others)
    total = len(items) + np.array([len(x) for x in others]) - shared
    return 100 * shared >= plan.percent * total


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                bool(_linked(np.frombuffer(left, np.uint64), [np.frombuffer(right, np.uint64)], plan)[0])
                for left, right in zip(batch["left"], batch["right"])
            ]
            yield batch.loc[keep, ["a", "b"]]

    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    return pairs.join(right, "b").join(left, "a").mapInPandas(confirm, "a binary, b binary")


def _plausible(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs that sizes and estimated similarity leave open."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            close = similarity(
                _words_of(batch["sa"]), _words_of(batch["sb"]), plan.lanes, plan.bits
            )
            yield batch.loc[close >= plan.percent / 100 - plan.slack, ["a", "b"]]

    side = classes.select("node", "n_shingles", "signature")
    a = side.toDF("a", "na", "sa")
    b = side.toDF("b", "nb", "sb")
    sized = 100 * F.least("na", "nb") >= plan.percent * F.greatest("na", "nb")
    return pairs.join(a, "a").join(b, "b").filter(sized).mapInPandas(judge, "a binary, b binary")


_CELL = ["bucket", "x", "y"]
_CELL_ROWS = (
    "bucket long, x int, y int, cut int, band int, node binary, root binary, n_shingles long, "
    "signature binary, marks binary"
)
_PAIRS_AT_ONCE = 16_000


def _dealt(members: DataFrame, roots: DataFrame, plan: Plan) -> DataFrame:
    """The members of buckets that hold several components, in cells: a bucket is cut into
    parts of bounded size, and a cell is one of the pairs of parts."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    buckets = (
        placed.groupBy("bucket")
        .agg(
            F.min("root").alias("lo"),
            F.max("root").alias("hi"),
            F.count(F.lit(1)).alias("n"),
            F.sum("n_shingles").alias("all"),
        )
        .filter("lo <> hi")
        .select(
            "bucket",
            F.greatest(F.ceil(F.col("n") / plan.cell), F.ceil(F.col("all") / plan.items))
            .cast("int")
            .alias("cuts"),
        )
    )
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    dealt = placed.join(buckets, "bucket").withColumn("cut", cut)
    other = F.sequence(F.lit(0), F.col("cuts") - 1)
    return dealt.withColumn("other", F.explode(other)).select(
        "bucket",
        F.least("cut", "other").alias("x"),
        F.greatest("cut", "other").alias("y"),
        "cut",
        "band",
        "node",
        "root",
        "n_shingles",
        "signature",
        "marks",
    )


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, bounds of the cells in them) of rows that come sorted by cell. A cell's rows
    come together, whatever batches they lie in."""
    left: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
        bounds = _bounds(rows)
        left = rows.iloc[bounds[-2] :].reset_index(drop=True) if len(bounds) > 1 else rows
        if len(bounds) > 2:
            yield rows.iloc[: bounds[-2]], bounds[:-1]
    if left is not None and len(left):
        yield left, _bounds(left)


def _bounds(rows: pd.DataFrame) -> np.ndarray:
    if not len(rows):
        return np.zeros(1, np.int64)
    keys = rows[_CELL].to_numpy()
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(rows)]])


def _pairs(rows: pd.DataFrame, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of each cell's two sides, small cells of equal size together."""
    sizes = np.diff(bounds)
    cut, x, y = (rows[name].to_numpy() for name in ("cut", "x", "y"))
    whole = x[bounds[:-1]] == y[bounds[:-1]]
    for size in np.unique(sizes[whole & (sizes <= 128)]):
        i, j = np.triu_indices(int(size), 1)
        starts = bounds[:-1][whole & (sizes == size)]
        step = max(_PAIRS_AT_ONCE // max(len(i), 1), 1)
        for k in range(0, len(starts), step):
            some = starts[k : k + step, None]
            yield (some + i).ravel(), (some + j).ravel()
    for k in np.flatnonzero(~whole | (sizes > 128)):
        places = np.arange(bounds[k], bounds[k + 1])
        left, right = places[cut[places] == x[places]], places[cut[places] == y[places]]
        step = max(_PAIRS_AT_ONCE // max(len(right), 1), 1)
        for at in range(0, len(left), step):
            i, j = (a.ravel() for a in np.meshgrid(left[at : at + step], right, indexing="ij"))
            yield (i[i < j], j[i < j]) if whole[k] else (i, j)


def _open_pairs(rows: pd.DataFrame, bounds: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that sizes and estimate leave open, each in the first
    of the buckets that it shares."""
    words = _words_of(rows["signature"])
    marks = np.frombuffer(b"".join(rows["marks"]), np.uint32).reshape(len(rows), -1)
    sizes, band = rows["n_shingles"].to_numpy(), rows["band"].to_numpy()
    roots = pd.factorize(rows["root"])[0]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _pairs(rows, bounds):
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        ok = (roots[i] != roots[j]) & (100 * small >= plan.percent * large)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), _PAIRS_AT_ONCE):
            a, b = i[k : k + _PAIRS_AT_ONCE], j[k : k + _PAIRS_AT_ONCE]
            first = (marks[a] == marks[b]).argmax(axis=1) == band[a]
            a, b = a[first], b[first]
            close = similarity(words[a], words[b], plan.lanes, plan.bits)
            ok = close >= plan.percent / 100 - plan.slack
            found.append((a[ok], b[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _undecided(dealt: DataFrame, plan: Plan) -> DataFrame:
    """The rows of cells that take part in a pair still open."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _cells(batches):
            i, j = _open_pairs(rows, bounds, plan)
            yield rows.iloc[np.unique(np.concatenate([i, j]))]

    return dealt.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(judge, _CELL_ROWS)


def _joining(undecided: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): links of cells that join components, compared on full sets. A pair is not
    compared once links found before have joined its components."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _cells(batches):
            i, j = _open_pairs(rows, bounds, plan)
            yield pd.DataFrame(_forest(rows, i, j, plan), columns=["a", "b"])

    met = undecided.join(sets, "node").select(*undecided.columns, "items")
    sorted_ = met.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    return sorted_.mapInPandas(link, "a binary, b binary").distinct()


def _forest(
    rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, plan: Plan
) -> list[tuple[bytes, bytes]]:
    nodes, items = rows["node"].tolist(), rows["items"].tolist()
    roots = pd.factorize(rows["root"])[0]
    above = list(range(int(roots.max(initial=-1)) + 1))

    def top(root: int) -> int:
        while above[root] != root:
            above[root] = above[above[root]]
            root = above[root]
        return root

    # Members with most open pairs first: one that is linked with many joins them all.
    both = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(both[0], kind="stable")
    own, partner = both[0][order], both[1][order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    groups = np.split(partner, starts[1:]) if len(own) else []
    out = []
    for k in sorted(range(len(groups)), key=lambda k: -len(groups[k])):
        at = int(own[starts[k]])
        mine = np.frombuffer(items[at], np.uint64)
        apart = [p for p in groups[k].tolist() if top(roots[p]) != top(roots[at])]
        for first in range(0, len(apart), 256):
            some = [p for p in apart[first : first + 256] if top(roots[p]) != top(roots[at])]
            if not some:
                continue
            linked = _linked(mine, [np.frombuffer(items[p], np.uint64) for p in some], plan)
            for p in np.array(some)[linked].tolist():
                if top(roots[p]) != top(roots[at]):
                    above[top(roots[p])] = top(roots[at])
                    out.append((min(nodes[at], nodes[p]), max(nodes[at], nodes[p])))
    return out


def near_duplicates(
    docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept), one row for each input row.

    component_id is the smallest id reachable over links, the row's own included;
    kept: the id is that one. text_key (xxhash64 of the text) tells rows of one id
    apart. Null and empty texts have no shingles and no link: they are their own
    component. Rows of a null id take part in no component's name; if a component
    has no other id, component_id is null. Such rows are kept unless another id
    stands for them. Rows alike in id and text stay or go together. An empty table
    gives an empty table; texts have no limit.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(text).alias("text"),
    )
    signed = stored(_signed(rows, plan), "signatures")
    with_words = signed.filter(F.col("node").isNotNull())
    classes = with_words.groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_key")).alias("source"),
        F.max("n_shingles").alias("n_shingles"),
        F.min("signature").alias("signature"),
        F.min("buckets").alias("buckets"),
    )
    classes = stored(classes, "classes")
    dealt = classes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    hubs = (
        dealt.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.max("node").alias("_top"))
        .filter("hub <> _top")
        .drop("_top")
    )
    members = stored(dealt.join(hubs.repartition("bucket"), "bucket"), "members")
    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    # Texts of classes that share a bucket with another one, from one of their rows.
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", F.col("source.doc_id").alias("id"), "source.text_key")
    texts = (
        rows.join(
            wanted.repartition("text_key").withColumnRenamed("text_key", "key"),
            F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")),
        )
        .select("node", "text")
        .dropDuplicates(["node"])
    )
    sets = stored(_shingle_sets(texts, plan), "sets")

    pairs = stored(_plausible(stars.distinct(), classes, plan), "pairs")
    links = stored(_confirmed(pairs, sets, plan), "confirmed")
    # Four bytes of each bucket tell which of them two members share.
    low = F.transform("buckets", lambda one: F.right(F.lpad(F.hex(one), 16, "0"), F.lit(8)))
    marked = classes.select(
        "node", "n_shingles", "signature", F.unhex(F.array_join(low, "")).alias("marks")
    )
    signed_members = members.select("bucket", "band", "node").join(marked, "node")
    undecided = stored(_undecided(_dealt(signed_members, connected(links), plan), plan), "undecided")
    links = links.unionByName(stored(_joining(undecided, sets, plan), "joining"))
    roots = connected(links)
    rooted = classes.select("node", "first_id").join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names.repartition("root"), "root").select("node", "component_id")
    out = with_words.select("doc_id", "text_key", "n_shingles", "node").join(
        named.repartition("node"), "node", "left"
    )
    plain = signed.filter(F.col("node").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_key", "n_shingles", "component_id"]
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return (
        out.select(columns).unionByName(plain.select(columns)).withColumn("kept", stays)
    )


def one_of_each(
    docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without those that another of their component stands for."""
    gone = (
        near_duplicates(docs, plan, doc_id, text)
        .filter(~F.col("kept"))
        .select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"))
        .distinct()
    )
    same = docs[doc_id].eqNullSafe(gone["_gone_id"]) & (
        F.xxhash64(docs[text]) == gone["_gone_key"]
    )
    return docs.join(gone, same, "left_anti")

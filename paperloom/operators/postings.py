"""Exact lexical search over an inverted index.

Words of chunks weigh their count times ln(1 + chunks / chunks with the word); questions
and chunks are compared by the cosine of these weights. Chunks are dealt into shards of
bounded size and numbered within them. A shard's words are dealt into buckets; a row of the
index has the words of a shard and a bucket: for each the number of all chunks with the
word, and the numbers of the shard's chunks that hold it, with their counts, as compressed
arrays. One more row a shard has its chunks' keys and the lengths of their weights.

A search reads the buckets of the questions' words, and passes on these words alone. A word's
numbers are cut into blocks of 256 with their largest weight. The sum of the largest weights
bounds what any chunk of a block can score; blocks are opened by that bound, and those
that cannot reach the k-th best score so far are skipped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.operators.embedding import numbered_words, words_of
from paperloom.operators.retrieval import one_array

CHUNKS_PER_SHARD = 20_000
QUESTIONS_PER_SLICE = 8_000
BUCKETS = 64
#: Chunk numbers of a block: a number's distance from its start is one byte.
BLOCK = 256
# Characters that are cut into words at a time, and counts that a task holds before it
# passes them on.
_CHARACTERS_AT_ONCE = 1 << 20
_COUNTS_PER_PACK = 1 << 22
# Shards whose words of one part of all words are summed in one task.
_SHARDS_PER_PART = 8
# Bytes of the questions' words that are sent to every task.
_WORD_BYTES = 32 * 1024 * 1024
# Shards, and slices of questions, that a task has one after another, at most.
_SHARDS_TOGETHER = 16
_SLICES_TOGETHER = 16
# Blocks opened first, and how many times more in each further turn.
_OPENED = 4
_MORE = 4
# Share of the blocks beyond which all are opened at once.
_WHOLE = 0.6
# Partitions for each cell of questions and shards, so that few cells share one, and at most.
_SPREAD = 2
_MOST_PARTITIONS = 4096
# Groups of shards for each core, at least.
_GROUPS_PER_CORE = 4
_SCORE_DIGITS = 10
_SLACK = 1e-9
#: Marks the rows that hold a shard's keys in place of a word.
KEYS = -1

_COUNTED = (
    "shard int, pack long, part int, entries int, "
    "terms binary, held binary, numbers binary, counts binary"
)
POSTING_SCHEMA = (
    "shard int, bucket int, entries int, "
    "terms binary, spread binary, held binary, numbers binary, weights binary"
)
_POSTINGS = (
    "shard int, term string, bucket int, idf double, "
    "blocks binary, ends binary, most binary, places binary, weights binary"
)


def _bucket(term: Column) -> Column:
    return (F.crc32(F.encode(term, "UTF-8")) % BUCKETS).cast("int")


def _pack(values: np.ndarray) -> bytes:
    """Values compressed, their first bytes together, then their second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return _packed(planes.tobytes())


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_words(words: list[bytes]) -> bytes:
    """Words have letters and digits only."""
    return _packed(b"\n".join(words))


def _unpack_words(data: bytes) -> pa.Array:
    written = _unpacked(data)
    return pa.array(written.split(b"\n") if written else [], pa.binary())


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes of consecutive runs of values, a cell for each run."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    buffers = [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of consecutive runs, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _steps(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of growing numbers as the first of each run and the distances from one to the next."""
    steps = np.diff(numbers, prepend=0)
    first = np.cumsum(sizes) - sizes
    steps[first] = numbers[first]
    return steps.astype("<u4")


def _numbers(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What :func:`_steps` was given."""
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    return sums - np.repeat(sums[first] - steps[first], sizes)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


_COUNTED_ARROW = pa.schema(
    [("shard", pa.int32()), ("pack", pa.int64()), ("part", pa.int32()), ("entries", pa.int32())]
    + [(name, pa.binary()) for name in ("terms", "held", "numbers", "counts")]
)
_INDEX_ARROW = pa.schema(
    [("shard", pa.int32()), ("bucket", pa.int32()), ("entries", pa.int32())]
    + [(name, pa.binary()) for name in ("terms", "spread", "held", "numbers", "weights")]
)


class _Pack:
    """Words of the chunks that a task has met for one shard, as arrays."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.chunks = self.held = 0

    def add(self, keys: np.ndarray, texts: list[str]) -> None:
        rows, numbers, words = numbered_words([text.lower() for text in texts])
        found, counts = np.unique(numbers * np.int64(len(texts)) + rows, return_counts=True)
        word, row = np.divmod(found, len(texts))
        self.postings.append((word.astype(np.int32), (row + self.chunks).astype(np.int32), counts.astype(np.int32)))
        self.words.append(words.cast(pa.binary()))
        self.keys.append(keys)
        self.chunks += len(texts)
        self.held += len(found)

    def rows(self, shard: int, number: int, parts: int) -> Iterator[tuple]:
        """A row for each part of the words, and one for the keys."""
        documents, indexes = np.concatenate(self.keys, axis=1)
        yield shard, number, KEYS, self.chunks, _pack(documents), None, _pack(indexes), None
        met = pa.chunked_array(self.words).combine_chunks()
        met = one_array(pa.chunked_array([met])).dictionary_encode()
        offsets = np.cumsum([0, *(len(words) for words in self.words)])
        own = met.indices.to_numpy()
        word = np.concatenate([own[w + at] for (w, _, _), at in zip(self.postings, offsets)])
        row, count = (np.concatenate([x[n] for x in self.postings]) for n in (1, 2))
        terms = met.dictionary.to_pylist()
        part = np.fromiter((zlib.crc32(term) % parts for term in terms), np.int64, len(terms))
        # Words by part, and within a part in their order.
        alphabet = np.empty(len(terms), np.int64)
        alphabet[pc.sort_indices(met.dictionary).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((alphabet, part))
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        by_word = np.lexsort((row, place[word]))
        row, count, held = row[by_word], count[by_word], np.bincount(place[word], minlength=len(terms))
        limits = np.concatenate([[0], np.cumsum(held)])
        edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        for start, end in zip(edges[:-1], edges[1:]):
            own, span = held[start:end], slice(limits[start], limits[end])
            yield (
                shard,
                number,
                int(part[order[start]]),
                int(end - start),
                _pack_words([terms[at] for at in order[start:end]]),
                _pack(own.astype("<u4")),
                _pack(_steps(row[span], own)),
                _pack(count[span].astype("<u4")),
            )


def shard_counts(chunks: DataFrame, per_shard: int = CHUNKS_PER_SHARD) -> DataFrame:
    """(shard, pack, part, entries, terms, held, numbers, counts): the words of the chunks that
    a task has for a shard, which are a pack, by parts of all words, with the number of chunks
    that hold each, these chunks and how often. One row a pack has its chunks' keys.

    Chunks are ``document_id, chunk_index, chunk_text``. They are counted where they are read
    and go to shards in the order in which a task reads them, so no text is shuffled, and
    a shard has chunks of few tasks. Store the rows before they are used: what a
    task gives depends on that order.
    """
    keys = ["document_id", "chunk_index"]
    rows = chunks.select(*[F.col(name).cast("long").alias(name) for name in keys], "chunk_text")
    # A number for each partition. If they are others when the chunks are read, shards
    # are of other sizes, and no less right.
    sizes = rows.groupBy(F.spark_partition_id().alias("_at")).count().orderBy("_at").collect()
    total = sum(row["count"] for row in sizes)
    shards = max(-(-total // per_shard), 1)
    parts = BUCKETS * -(-shards // (_SHARDS_PER_PART * BUCKETS))
    before = dict(zip((row["_at"] for row in sizes), np.cumsum([0, *(row["count"] for row in sizes)]).tolist()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at, packs, pack, shard = before.get(task, 0), 0, _Pack(), None

        def given() -> Iterator[pa.RecordBatch]:
            made = pack.rows(shard, (task << 32) + packs, parts)
            yield from _table(list(made), _COUNTED_ARROW).to_batches()

        for batch in batches:
            texts = [text or "" for text in batch.column("chunk_text").to_pylist()]
            own = np.stack([batch.column(name).to_numpy().astype("<i8") for name in keys])
            ends = np.cumsum([len(text) for text in texts])
            start = 0
            while start < len(texts):
                if pack.chunks and (shard != at // per_shard % shards or pack.held > _COUNTS_PER_PACK):
                    yield from given()
                    pack, packs = _Pack(), packs + 1
                shard = at // per_shard % shards
                least = (ends[start - 1] if start else 0) + _CHARACTERS_AT_ONCE
                end = max(int(np.searchsorted(ends, least, side="right")), start + 1)
                end = min(end, start + per_shard - at % per_shard)
                pack.add(own[:, start:end], texts[start:end])
                at, start = at + end - start, end
        if pack.chunks:
            yield from given()

    return rows.mapInArrow(count, _COUNTED)


def posting_lists(counted: DataFrame) -> DataFrame:
    """The index from :func:`shard_counts`: a row for each shard and part of the words, and
    one for the keys of each shard.

    A word's number of chunks is summed where all shards' words of a part of them meet, as
    compressed arrays, and sent back to the shards as numbers in their words' order. So
    counts are shuffled once, by shard."""
    known = counted.filter(F.col("part") == KEYS).agg(
        F.sum("entries").alias("chunks"), F.max("shard").alias("last")
    ).first()
    total, shards = known["chunks"] or 0, (known["last"] or 0) + 1
    tasks = _groups(counted.sparkSession, shards) * _SPREAD

    def summed(rows: pa.Table) -> pa.Table:
        lists = [_unpack_words(terms) for terms in rows.column("terms").to_pylist()]
        met = one_array(pa.chunked_array(lists)).dictionary_encode().indices.to_numpy()
        held = np.concatenate([_unpack(x, "<u4") for x in rows.column("held").to_pylist()])
        spread = np.bincount(met, weights=held).astype("<u4")[met]
        ends = np.cumsum([len(words) for words in lists])[:-1]
        made = [_pack(own) for own in np.split(spread, ends)]
        return rows.drop_columns(["terms", "held"]).append_column("spread", pa.array(made, pa.binary()))

    words = counted.filter(F.col("part") != KEYS).select("shard", "pack", "part", "terms", "held")
    spread = words.groupBy("part").applyInArrow(
        summed, "shard int, pack long, part int, spread binary"
    )

    def merged(own: pa.Table, spread: pa.Table) -> pa.Table:
        rows = list(_merged(own, spread, total)) if own.num_rows else []
        return _table(rows, _INDEX_ARROW)

    sides = [side.repartition(tasks, "shard").groupBy("shard") for side in (counted, spread)]
    return sides[0].cogroup(sides[1]).applyInArrow(merged, POSTING_SCHEMA)


def _merged(own: pa.Table, spread: pa.Table, total: int) -> Iterator[tuple]:
    """One shard's rows of the index from its packs and their words' numbers of chunks."""
    shard = own.column("shard")[0].as_py()
    known = {
        (pack, part): numbers
        for pack, part, numbers in zip(*(spread.column(x).to_pylist() for x in ("pack", "part", "spread")))
    }
    keyed = own.filter(pc.equal(own.column("part"), KEYS)).sort_by("pack")
    packs = keyed.column("pack").to_pylist()
    documents, indexes = (
        np.concatenate([_unpack(x, "<i8") for x in keyed.column(name).to_pylist()])
        for name in ("terms", "numbers")
    )
    # Chunks are numbered in the order of their keys.
    order = np.lexsort((indexes, documents))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    sizes = keyed.column("entries").to_numpy()
    first = dict(zip(packs, np.cumsum(sizes) - sizes))
    squares = np.zeros(len(order))
    by_part: dict[int, list[int]] = {}
    for at, part in enumerate(own.column("part").to_pylist()):
        if part != KEYS:
            by_part.setdefault(part, []).append(at)
    for part, places in sorted(by_part.items()):
        rows = [{name: own.column(name)[at].as_py() for name in own.schema.names} for at in places]
        met = one_array(pa.chunked_array([_unpack_words(row["terms"]) for row in rows])).dictionary_encode()
        sums = np.concatenate([_unpack(known[row["pack"], part], "<u4") for row in rows])
        words, ends, counts, held = met.indices.to_numpy(), [], [], []
        for row in rows:
            held.append(_unpack(row["held"], "<u4").astype(np.int64))
            ends.append(number[first[row["pack"]] + _numbers(_unpack(row["numbers"], "<u4"), held[-1])])
            counts.append(_unpack(row["counts"], "<u4"))
        word = np.repeat(words, np.concatenate(held))
        chunk, count = np.concatenate(ends), np.concatenate(counts)
        by_word = np.lexsort((chunk, word))
        word, chunk, count = word[by_word], chunk[by_word], count[by_word]
        chunks = np.zeros(len(met.dictionary), "<u4")
        chunks[words] = sums
        squares += np.bincount(chunk, (count * _idf(chunks, total)[word]) ** 2, len(squares))
        sizes = np.bincount(word, minlength=len(chunks))
        yield (
            shard,
            part % BUCKETS,
            len(chunks),
            _pack_words(met.dictionary.to_pylist()),
            _pack(chunks),
            _pack(sizes.astype("<u4")),
            _pack(_steps(chunk, sizes)),
            _pack(count),
        )
    lengths = _pack(np.sqrt(squares))
    yield shard, KEYS, len(order), _pack(documents[order]), None, None, _pack(indexes[order]), lengths


def _idf(chunks: np.ndarray, total: int) -> np.ndarray:
    return np.log1p(total / chunks)


def _groups(spark: SparkSession, shards: int) -> int:
    """Groups of shards that tasks have: enough for all cores, and of bounded size."""
    enough = _GROUPS_PER_CORE * spark.sparkContext.defaultParallelism
    return min(shards, max(enough, -(-shards // _SHARDS_TOGETHER)))


def _known(index: DataFrame) -> tuple[int, int]:
    """Number of chunks and of shards."""
    keys = index.filter(F.col("bucket") == KEYS)
    row = keys.agg(F.sum("entries").alias("chunks"), F.max("shard").alias("last")).first()
    return row["chunks"] or 0, (row["last"] or 0) + 1


def weighted_postings(counted: DataFrame) -> DataFrame:
    """What a search makes of the index: a row for each shard and word with its blocks and
    weights, and one for the keys of each shard."""
    index = posting_lists(counted)
    total, _ = _known(index)

    def weigh(rows: pa.Table) -> pa.Table:
        own = _Shard(rows, total)
        words = list(own.words)
        blocks, sizes = np.diff(own.first), own.postings
        ends = own.starts + own.sizes - np.repeat(own.bounds[:-1], blocks)
        none = [pa.nulls(1, kind) for kind in (pa.string(), pa.float64(), pa.binary())]
        keys = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in own.keys]
        made = {
            "term": pa.concat_arrays([none[0], pa.array(words, pa.string())]),
            "bucket": pa.array([KEYS, *(zlib.crc32(x.encode()) % BUCKETS for x in words)], pa.int32()),
            "idf": pa.concat_arrays([none[1], pa.array(own.idf, pa.float64())]),
            "blocks": pa.concat_arrays([keys[0], _cut(own.block.astype("<i4"), blocks)]),
            "ends": pa.concat_arrays([keys[1], _cut(ends.astype("<i4"), blocks)]),
            "most": pa.concat_arrays([none[2], _cut(own.most, blocks)]),
            "places": pa.concat_arrays([none[2], _cut((own.numbers % BLOCK).astype(np.uint8), sizes)]),
            "weights": pa.concat_arrays([none[2], _cut(own.weights, sizes)]),
        }
        shard = pa.array([rows.column("shard")[0].as_py()] * (len(words) + 1), pa.int32())
        return pa.table({"shard": shard, **made})

    return index.repartition("shard").groupBy("shard").applyInArrow(weigh, _POSTINGS)


def question_terms(questions: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, term, count) of the words of each question."""
    schema = questions.select(
        "query_id", F.lit("").alias("term"), F.lit(0).alias("count")
    ).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [pd.Series(words_of(t or ""), dtype=object).value_counts() for t in batch.column(text).to_pylist()]
            sizes = [len(x) for x in own]
            at = np.repeat(np.arange(batch.num_rows), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query_id").take(pa.array(at)),
                    pa.array([word for x in own for word in x.index], pa.string()),
                    pa.array([int(n) for x in own for n in x], pa.int32()),
                ],
                names=["query_id", "term", "count"],
            )

    return questions.select("query_id", text).mapInArrow(count, schema)


def search(
    questions: DataFrame,
    index: DataFrame,
    k: int = fixed.TOP_K,
    text: str = "query",
    questions_per_slice: int = QUESTIONS_PER_SLICE,
) -> DataFrame:
    """(query_id, rank, document_id, chunk_index, score): the k chunks most similar to each
    question, of those that share a word with it; ties by document and index.

    Exact: scores have 10 digits. Words that no chunk holds have no weight; questions
    without others find nothing, as do null and empty ones, and questions of a null id. Rows of
    one query_id are one question. Questions meet shards in cells of bounded size.
    """
    found = _cells(questions, index, k, text, questions_per_slice).filter("score is not null")
    order = [F.col("score").desc(), F.col("document_id"), F.col("chunk_index")]
    part = F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(32))
    some = found.withColumn("_part", part)
    for keys in (["query_id", "_part"], ["query_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        some = some.withColumn("rank", rank).filter(F.col("rank") <= k)
    return some.select("query_id", "rank", "document_id", "chunk_index", "score")


def opened(
    questions: DataFrame,
    index: DataFrame,
    k: int = fixed.TOP_K,
    text: str = "query",
    questions_per_slice: int = QUESTIONS_PER_SLICE,
) -> DataFrame:
    """(query_id, postings, opened): postings of a question's words, and those in blocks that
    the search opens."""
    found = _cells(questions, index, k, text, questions_per_slice).filter("score is null")
    return found.groupBy("query_id").agg(
        F.sum("document_id").alias("postings"), F.sum("chunk_index").alias("opened")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array, np.ndarray | None]]:
    """Each row of an index with its words, and the places of those that are asked for."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at] for name in batch.schema.names}
            words = _unpack_words(row["terms"].as_py())
            if not row["asked"].is_valid:
                yield row, words, np.arange(len(words))
                continue
            found = pc.is_in(words, row["asked"].values.cast(pa.binary()))
            yield row, words, np.flatnonzero(found.to_numpy(zero_copy_only=False))


def _cells(questions: DataFrame, index: DataFrame, k: int, text: str, per_slice: int) -> DataFrame:
    """Best chunks of questions by groups of shards, and one row a question and group with a null
    score and, in place of the keys, the postings there are and those opened."""
    counted = question_terms(questions.filter(F.col("query_id").isNotNull()), text)
    counted = counted.groupBy("query_id", "term").agg(F.sum("count").cast("int").alias("count"))
    words = counted.select("term").distinct().withColumn("bucket", _bucket(F.col("term")))
    # What is collected is at most one number a bucket; other buckets' files are not read.
    size = F.sum(F.octet_length("term") + 8).alias("size")
    sizes = {row["bucket"]: row["size"] for row in words.groupBy("bucket").agg(size).collect()}
    held = index.filter(F.col("bucket").isin([*sizes, KEYS]))
    rows = held.filter(F.col("bucket") != KEYS)
    if sum(sizes.values()) <= _WORD_BYTES:
        asked_for = words.groupBy("bucket").agg(F.collect_list("term").alias("asked"))
        rows = rows.join(F.broadcast(asked_for), "bucket")
    else:
        # All words of their buckets are passed on: more bytes, the same results.
        rows = rows.withColumn("asked", F.lit(None).cast("array<string>"))
    total, shards = _known(held)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, terms, places in _kept(batches):
            idf = _idf(_unpack(row["spread"].as_py(), "<u4")[places], total)
            made = [terms.take(pa.array(places)).cast(pa.string()), pa.array(idf)]
            yield pa.RecordBatch.from_arrays(made, names=["term", "idf"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, terms, places in _kept(batches):
            if not len(places):
                continue
            sizes = _unpack(row["held"].as_py(), "<u4").astype(np.int64)
            use = _runs((np.cumsum(sizes) - sizes)[places], sizes[places])
            cut = {name: _unpack(row[name].as_py(), "<u4") for name in ("spread", "numbers", "weights")}
            own = (
                row["shard"].as_py(),
                row["bucket"].as_py(),
                len(places),
                _pack_words(terms.take(pa.array(places)).to_pylist()),
                _pack(cut["spread"][places]),
                _pack(sizes[places].astype("<u4")),
                _pack(cut["numbers"][use]),
                _pack(cut["weights"][use]),
            )
            yield from _table([own], _INDEX_ARROW).to_batches()

    weights = rows.select("terms", "spread", "asked").mapInArrow(weigh, "term string, idf double").distinct()
    asked = counted.join(weights, "term").withColumn("weight", F.col("count") * F.col("idf"))
    slices = max(-(-questions.count() // per_slice), 1)
    groups = _groups(questions.sparkSession, shards)
    # Slices that go together: few enough for memory, and cells enough for all cores.
    cores = questions.sparkSession.sparkContext.defaultParallelism
    columns = max(-(-slices // _SLICES_TOGETHER), -(-_GROUPS_PER_CORE * cores // groups))
    columns = min(columns, slices)

    every = F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("slice")
    names = _INDEX_ARROW.names
    kept = rows.select(*names, "asked").mapInArrow(keep, POSTING_SCHEMA)
    left = kept.unionByName(held.filter(F.col("bucket") == KEYS).select(*names)).select(
        "*", (F.col("shard") % groups).alias("group"), every
    )
    # A row a question, then one a slice: these meet every group of shards.
    own = F.collect_list(F.struct("term", "weight")).alias("own")
    kind = questions.select("query_id").schema["query_id"].dataType.simpleString()
    by_slice = asked.groupBy("query_id").agg(own).select(
        "query_id",
        F.col("own.term").alias("terms"),
        F.col("own.weight").alias("weights"),
        F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice"),
    )

    def slice_up(rows: pa.Table) -> pa.Table:
        ids = one_array(rows.column("query_id"))
        terms, weights = (one_array(rows.column(name)) for name in ("terms", "weights"))
        sizes = pc.list_value_length(terms).to_numpy().astype("<u4")
        words = terms.flatten().cast(pa.binary()).to_pylist()
        made = {
            "query_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "sizes": pa.array([_pack(sizes)], pa.binary()),
            "terms": pa.array([_pack_words(words)], pa.binary()),
            "weights": pa.array([_pack(weights.flatten().to_numpy().astype("<f8"))], pa.binary()),
        }
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py() % columns], pa.int32()), **made})

    sliced = by_slice.groupBy("slice").applyInArrow(
        slice_up,
        f"slice int, query_ids array<{kind}>, sizes binary, terms binary, weights binary",
    )
    right = sliced.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema(
            [
                ("query_id", asked.schema.field("query_ids").type.value_type),
                ("document_id", pa.int64()),
                ("chunk_index", pa.int64()),
                ("score", pa.float64()),
            ]
        )
        if not own.num_rows or not asked.num_rows:
            return schema.empty_table()
        return _answers(own, asked, k, total, schema)

    keys = ["group", "slice"]
    # Partitions are given: cells of few bytes, but long work, stay in tasks of their own.
    partitions = min(_SPREAD * slices * groups, _MOST_PARTITIONS)
    sides = [side.repartition(partitions, *keys).groupBy(*keys) for side in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(
        run, f"query_id {kind}, document_id long, chunk_index long, score double"
    )


def _asked(row: dict) -> tuple[pa.Array, list[list[tuple[str, float]]]]:
    """Ids of a slice's questions, and the words of each in their order, of length one."""
    ends = np.cumsum(_unpack(row["sizes"].as_py(), "<u4"), dtype=np.int64)
    words = _unpack_words(row["terms"].as_py()).cast(pa.string()).to_pylist()
    weights = _unpack(row["weights"].as_py(), "<f8").tolist()
    asked = []
    for start, end in zip([0, *ends[:-1]], ends):
        own = sorted(zip(words[start:end], weights[start:end]))
        length = math.sqrt(sum(weight * weight for _, weight in own))
        asked.append([(term, weight / length) for term, weight in own])
    return row["query_ids"].values, asked


def _answers(own: pa.Table, asked: pa.Table, k: int, total: int, schema: pa.Schema) -> pa.Table:
    """The best chunks of questions among the shards of a group, one shard after another."""
    rows = [{name: asked.column(name)[at] for name in asked.schema.names} for at in range(asked.num_rows)]
    slices = [_asked(row) for row in rows]
    ids = pa.concat_arrays([own_ids for own_ids, _ in slices])
    questions = [question for _, some in slices for question in some]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(questions)
    postings, seen = [0] * len(questions), [0] * len(questions)
    for number in pc.unique(own.column("shard")).to_pylist():
        shard = _Shard(own.filter(pc.equal(own.column("shard"), number)), total)
        for who, question in enumerate(questions):
            document, chunk, score = best[who]
            floor = float(score[-1]) if len(score) == k else -math.inf
            found, scores, there, opened_ = shard.best(question, k, floor)
            postings[who], seen[who] = postings[who] + there, seen[who] + opened_
            if len(found):
                document = np.concatenate([document, shard.keys[0][found]])
                chunk = np.concatenate([chunk, shard.keys[1][found]])
                score = np.concatenate([score, scores])
                first = np.lexsort((chunk, document, -score))[:k]
                best[who] = document[first], chunk[first], score[first]
    sizes = [len(score) for _, _, score in best]
    # Behind each question's chunks, the row of its postings.
    who = np.repeat(np.arange(len(best)), np.array(sizes) + 1)
    ends = np.cumsum(np.array(sizes) + 1) - 1
    columns = [np.empty(len(who), np.int64), np.empty(len(who), np.int64), np.empty(len(who))]
    mine = np.ones(len(who), bool)
    mine[ends] = False
    for column, values, rest in zip(columns, zip(*best), (postings, seen, 0.0)):
        column[mine], column[ends] = np.concatenate(values), rest
    scores = pa.array(columns[2], mask=~mine)
    return pa.Table.from_arrays(
        [ids.take(pa.array(who)), pa.array(columns[0]), pa.array(columns[1]), scores], schema=schema
    )


class _Shard:
    """One shard's rows of the words that are asked for."""

    def __init__(self, rows: pa.Table, total: int):
        keyed = pc.equal(rows.column("bucket"), KEYS)
        keys, rows = rows.filter(keyed), rows.filter(pc.invert(keyed))
        self.keys = tuple(_unpack(keys.column(x)[0].as_py(), "<i8") for x in ("terms", "numbers"))
        lengths = _unpack(keys.column("weights")[0].as_py(), "<f8")
        terms = [_unpack_words(x) for x in rows.column("terms").to_pylist()]
        terms = one_array(pa.chunked_array(terms, pa.binary())).cast(pa.string())
        self.words = {term: at for at, term in enumerate(terms.to_pylist())}
        lists = {
            name: np.concatenate([np.zeros(0, "<u4"), *(_unpack(x, "<u4") for x in rows.column(name).to_pylist())])
            for name in ("spread", "held", "numbers", "weights")
        }
        self.idf = _idf(lists["spread"], total)
        self.postings = lists["held"].astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.postings)])
        self.numbers = _numbers(lists["numbers"], self.postings)
        weights = lists["weights"] * np.repeat(self.idf, self.postings)
        self.weights = weights / lengths[self.numbers]
        # A block opens where the word or the block's number changes.
        word, block = np.repeat(np.arange(len(self.words)), self.postings), self.numbers // BLOCK
        opens = np.ones(len(block), bool)
        opens[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        self.starts = np.flatnonzero(opens)
        self.sizes = np.diff(self.starts, append=len(block))
        self.block = block[self.starts]
        # Blocks of each word, in the words' order.
        self.first = np.searchsorted(self.starts, self.bounds)
        self.most = np.maximum.reduceat(self.weights, self.starts) if len(self.starts) else self.weights
        self.blocks = -(-len(self.keys[0]) // BLOCK)

    def best(
        self, asked: list[tuple[str, float]], k: int, floor: float = -math.inf
    ) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(chunk numbers, scores, postings, postings opened) of chunks that reach the floor."""
        own = [(self.words[term], weight) for term, weight in asked if term in self.words]
        found, top = np.zeros(0, np.int64), np.zeros(0)
        if not own:
            return found, top, 0, 0
        words = np.array([word for word, _ in own])
        there = int(self.postings[words].sum())
        held = self.first[words + 1] - self.first[words]
        entries = _runs(self.first[words], held)
        weight = np.repeat([weight for _, weight in own], held)
        block = self.block[entries]
        bound = np.bincount(block, weights=weight * self.most[entries], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, seen, turn = 0, 0, _OPENED
        while at < len(order) and bound[order[at]] >= floor - _SLACK:
            reach = int(np.count_nonzero(bound[order] >= floor - _SLACK))
            if at and reach > _WHOLE * len(order):
                # Most blocks are opened: rows of words as they lie, without a choice.
                spans = [slice(self.bounds[word], self.bounds[word + 1]) for word in words]
                numbers = np.concatenate([self.numbers[span] for span in spans])
                weights = np.concatenate([w * self.weights[x] for (_, w), x in zip(own, spans)])
                found, top = found[:0], top[:0]
                at, seen = len(order), there
            else:
                chosen = order[at : min(at + turn, reach)]
                at, turn = at + turn, turn * _MORE
                open_ = np.zeros(self.blocks, bool)
                open_[chosen] = True
                use = np.flatnonzero(open_[block])
                sizes = self.sizes[entries[use]]
                rows = _runs(self.starts[entries[use]], sizes)
                numbers = self.numbers[rows]
                weights = np.repeat(weight[use], sizes) * self.weights[rows]
                seen += len(rows)
            # Words are added in their order, so a sum is the same wherever it is made.
            scores = np.bincount(numbers, weights=weights)
            new = np.flatnonzero(scores > max(floor - _SLACK, 0.0))
            if len(new) > k:
                kth = np.partition(scores[new], len(new) - k)[len(new) - k]
                new = new[scores[new] >= kth - _SLACK]
            found = np.concatenate([found, new])
            top = np.concatenate([top, np.round(scores[new], _SCORE_DIGITS)])
            # Chunk numbers are in the order of their keys.
            first = np.lexsort((found, -top))[:k]
            found, top = found[first], top[first]
            if len(found) == k:
                floor = max(floor, float(top[-1]))
        return found, top, there, seen

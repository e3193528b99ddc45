"""Archive names over many batches, from state kept by name.

For each name there are intervals of the counters in use. A batch asks once for each
of its names, with the number of files that want it; it is granted runs of free
counters, and files take theirs by their position among those of the name. So neither
the state nor the work of a batch grows with the files that earlier batches brought.

Names that differ in trailing counters only (a, a_1, a_1_2) share one key: each of them
may be what another is counted to.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions.text import split_extension
from paperloom.plans import spread

_ENDING = re.compile(r"_([1-9][0-9]{0,17})$")
_ENDINGS = "(_[1-9][0-9]{0,17})+$"

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

REQUESTED = (
    "src_path string, file_name string, outcome string, target_folder string, position long"
)
TAKEN = "target_folder string, file_name string, root string, files long"
GRANTED = (
    "batch_id long, target_folder string, file_name string, position long, files long, counter long"
)


def requests(disposed: DataFrame) -> DataFrame:
    """Add ``position`` to handled files (``src_path, file_name, outcome, target_folder``):
    from 0, among the files of the same folder and name, in the order of their path's md5."""
    placed = spread.running_sum(
        disposed.withColumn("_order", F.md5("src_path")),
        ["target_folder", "file_name"],
        F.conv(F.substring("_order", 1, 2), 16, 10).cast("long"),
        ["_order", "src_path"],
        F.lit(1),
        "_served",
    )
    return placed.withColumn("position", F.col("_served") - 1).drop("_order", "_served")


def takes(requested: DataFrame) -> DataFrame:
    """(target_folder, file_name, root, files): one row for each name of a batch."""
    stem, extension = split_extension(F.col("file_name"))
    root = F.concat("target_folder", F.lit("/"), F.regexp_replace(stem, _ENDINGS, ""), extension)
    counted = requested.groupBy("target_folder", "file_name").agg(F.count(F.lit(1)).alias("files"))
    return counted.select("target_folder", "file_name", root.alias("root"), "files")


def granted_names(requested: DataFrame, grants: DataFrame) -> DataFrame:
    """Files of one batch with the ``archived_path`` of the batch's grants. A name has few
    grants and may have most of the files, which are dealt over several partitions."""
    keys = ["target_folder", "file_name"]
    runs = grants.select(*keys, F.col("position").alias("_first"), F.col("files").alias("_run"), "counter")
    met = spread.salted_join(requested, runs, keys, F.col("position"))
    behind = F.col("position") - F.col("_first")
    stem, extension = split_extension(F.col("file_name"))
    counter = F.col("counter") + behind
    name = F.when(counter == 0, F.col("file_name")).otherwise(
        F.concat(stem, F.lit("_"), counter.cast("string"), extension)
    )
    return met.filter((behind >= 0) & (behind < F.col("_run"))).select(
        "src_path", "file_name", "outcome", "target_folder",
        F.concat("target_folder", F.lit("/"), name).alias("archived_path"),
    )


def grant(taken: DataFrame) -> DataFrame:
    """Grants for a stream of :func:`takes` with their ``batch_id``, one after the other in
    its order. A batch that is asked for again, as after a failure, is granted what it was."""
    rows = taken.select("root", "batch_id", "target_folder", "file_name", "files")
    return rows.groupBy("root").transformWithStateInPandas(
        statefulProcessor=_Registry(),
        outputStructType=GRANTED,
        outputMode="append",
        timeMode="none",
    )


class Counters:
    """Counters in use, as intervals [first, last] in order."""

    def __init__(self, intervals: list[list[int]] | None = None):
        self.intervals = intervals or []

    def holds(self, counter: int) -> bool:
        return any(first <= counter <= last for first, last in self.intervals)

    def add(self, first: int, last: int) -> None:
        kept, low, high = [], first, last
        for a, b in self.intervals:
            if b < low - 1 or a > high + 1:
                kept.append([a, b])
            else:
                low, high = min(low, a), max(high, b)
        self.intervals = sorted([*kept, [low, high]])

    def free(self, count: int) -> list[tuple[int, int]]:
        """(counter, run) of the ``count`` lowest free counters from 1."""
        found, at = [], 1
        for first, last in [*self.intervals, [1 << 62, 1 << 62]]:
            if count and first > at:
                run = min(first - at, count)
                found.append((at, run))
                count -= run
            at = max(at, last + 1)
        return found


def counted_as(name: str) -> tuple[str, int]:
    """(name without its counter, counter); a name without one has 0."""
    stem, extension = os.path.splitext(name)
    found = _ENDING.search(stem)
    return (stem[: found.start()] + extension, int(found[1])) if found else (name, 0)


class Names:
    """The names of one key. ``read`` and ``write`` reach what is stored for a name."""

    def __init__(self, read, write):
        self.read, self.write = read, write

    def _used(self, name: str) -> dict:
        return self.read(name) or {"used": [], "batch": None, "grants": []}

    def serve(self, batch: int, files: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
        """(name, position, files, counter): what the batch's names are granted."""
        # A name that a file brings goes before one that another file would get by counting.
        used = {}
        for name in files:
            own, counter = counted_as(name)
            for base in {name, own}:
                used.setdefault(base, self._used(base))
        fresh = {}
        for name in sorted(files):
            own, counter = counted_as(name)
            counters = Counters(used[own]["used"])
            fresh[name] = not counters.holds(counter)
            counters.add(counter, counter)
            used[own]["used"] = counters.intervals
        for name, count in sorted(files.items()):
            row = used[name]
            if row["batch"] != batch:
                row["batch"] = batch
                row["grants"] = [[0, 1, 0]] if fresh[name] else []
            before = sum(run for _, run, _ in row["grants"])
            counters = Counters(row["used"])
            for counter, run in counters.free(max(count - before, 0)):
                row["grants"].append([before, run, counter])
                before += run
                counters.add(counter, counter + run - 1)
            row["used"] = counters.intervals
            for position, run, counter in row["grants"]:
                yield name, position, run, counter
        for name, row in used.items():
            self.write(name, row)


class _Registry(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("names", "name string", "value string")

    def _read(self, name: str) -> dict | None:
        return json.loads(self.kept.getValue((name,))[0]) if self.kept.containsKey((name,)) else None

    def _write(self, name: str, value: dict) -> None:
        self.kept.updateValue((name,), (json.dumps(value),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One row for each name and batch: few, however many files there are.
        asked = pd.concat(list(rows)).drop_duplicates(["batch_id", "file_name"], keep="last")
        folder = str(asked["target_folder"].iloc[0])
        out = []
        names = Names(self._read, self._write)
        for batch, part in asked.sort_values("batch_id").groupby("batch_id"):
            files = dict(zip(part["file_name"], (int(n) for n in part["files"])))
            for name, position, run, counter in names.serve(int(batch), files):
                out.append((int(batch), folder, name, position, run, counter))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in GRANTED.split(", ")])

    def close(self) -> None:
        pass



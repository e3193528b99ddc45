"""Small helpers the operators share: shared folder, stored tables, sizing."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset a local
    session, whose executors are the driver, gets a temporary folder; on a cluster
    it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-shared-")
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there,
    and what follows survives the loss of executors without computing it again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks_of(frame: DataFrame, size: Column, block_size: int) -> int:
    """How many blocks of about ``block_size`` the sum of ``size`` makes; at least one."""
    total = frame.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, -(-int(total) // block_size))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that the frame's columns do not hold yet."""
    taken = {column.lower() for column in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def kept_in_worker(key: tuple, make: Callable[[], Any], most: int = 4) -> Any:
    """``make()``, once for each key in the life of a worker process.

    Functions reach workers by value, with new globals for each task; what is kept
    lives in a module that is always there."""
    kept = sys.__dict__.setdefault("_paperloom_kept", {})
    if key not in kept:
        if len(kept) >= most:
            kept.clear()
        kept[key] = make()
    return kept[key]


class Memo(dict):
    """What a worker remembers of words: ``memo[word]`` is ``make(word)``, computed once
    while the word stays in use. Words are held in two generations of at most
    ``limit``; when the new one is full it becomes the old one. Long ones are not held."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.old: dict = {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

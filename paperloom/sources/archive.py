"""Moving handled files to where the tables say they are."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What becomes of a file: it lies at its target; it is nowhere; its target holds another file.
ARCHIVED, MISSING, TAKEN = "archived", "missing", "taken"

MOVED = "src_path string, target_path string, state string"

Mover = Callable[[str, str], str]

_PIECE = 1 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name as Spark writes it: ``file:/a b`` or ``hdfs://h/a b``."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        # A name is no URL: "?", "#" and "%" stand for themselves.
        plain = path[len("file:") :] if parts.scheme else path
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    system, _ = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    rest = path.split("://", 1)[1].split("/", 1)[1]
    # Object stores name the bucket first, file systems begin at the root.
    return system, f"{parts.netloc}/{rest}" if parts.scheme in ("s3", "gs") else f"/{rest}"


def move_file(source: str, target: str) -> str:
    """Rename a file, never onto another one. Safe to repeat, alone or at the same time:
    a file that was moved before is ``archived``, and of a file that lies in both places,
    as where a rename is a copy that was cut off, the source goes once they are equal."""
    system, old = open_path(source)
    _, new = open_path(target)
    there = system.get_file_info([old, new])
    if there[0].type == fs.FileType.NotFound:
        return MISSING if there[1].type == fs.FileType.NotFound else ARCHIVED
    if there[1].type == fs.FileType.NotFound:
        system.create_dir(os.path.dirname(new), recursive=True)
        if not isinstance(system, fs.LocalFileSystem):
            system.move(old, new)
            return ARCHIVED
        try:
            os.link(old, new)  # fails, unlike a rename, where another file came first
        except FileExistsError:
            return move_file(source, target)
        except FileNotFoundError:
            return move_file(source, target)
    elif there[0].size != there[1].size or not _equal(system, old, new):
        return TAKEN
    try:
        system.delete_file(old)
    except FileNotFoundError:
        pass
    return ARCHIVED


def _equal(system: fs.FileSystem, left: str, right: str) -> bool:
    with system.open_input_stream(left) as a, system.open_input_stream(right) as b:
        while True:
            x, y = a.read(_PIECE), b.read(_PIECE)
            if x != y:
                return False
            if not x:
                return True


def moved_files(disposed: DataFrame, archive_folder: str, mover: Mover = move_file) -> DataFrame:
    """(src_path, target_path, state) of files (``src_path, archived_path``), which reading
    this frame moves below ``archive_folder``. Tasks move the files of their rows; as a
    move can be repeated, so can a task."""
    rows = disposed.select(
        "src_path",
        F.concat(F.lit(archive_folder.rstrip("/") + "/"), "archived_path").alias("target_path"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(column.to_pylist() for column in batch.columns))
            states = pa.array([mover(old, new) for old, new in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, states], ["src_path", "target_path", "state"])

    return rows.mapInArrow(run, MOVED)

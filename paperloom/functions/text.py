"""Column expressions over names, paths, texts and times. All run in the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed


def file_name(path: Column) -> Column:
    """Part of a path after its last slash."""
    return F.substring_index(path, "/", -1)


def has_document_suffix(name: Column) -> Column:
    return F.lower(name).endswith(fixed.FILE_SUFFIX)


def last_dot_part(name: Column) -> Column:
    """Text after the last dot; the whole name when it has none."""
    return F.substring_index(name, ".", -1)


def split_extension(name: Column) -> tuple[Column, Column]:
    """(stem, extension with its dot). Leading dots belong to the stem."""
    extension = F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    return stem, extension


def uuid_from(seed: Column) -> Column:
    """UUID-shaped text derived from a seed: same seed, same UUID, on any retry."""
    digest = F.md5(seed)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def document_uuid(path: Column, version: Column) -> Column:
    """First UUID in the file name, case kept, else one derived from the file's
    path and version (its modification time), so recomputed tasks agree."""
    found = F.regexp_extract(file_name(path), fixed.UUID_PATTERN, 0)
    derived = uuid_from(F.concat_ws("|", path, version.cast("string")))
    return F.when(found != "", found).otherwise(derived)


def word_count(text: Column) -> Column:
    """Runs of other characters than white space: the pieces between runs of it, less
    the empty ones that white space at either end makes."""
    pieces = F.size(F.split(text, fixed.WHITESPACE + "+"))
    ends = text.rlike("^" + fixed.WHITESPACE).cast("int") + text.rlike(
        fixed.WHITESPACE + "\\z"
    ).cast("int")
    return F.when(text == "", 0).otherwise(pieces - ends).cast("int")


def strip(text: Column) -> Column:
    edges = f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$"
    return F.regexp_replace(text, edges, "")


def as_timestamp(moment: Column | datetime | str) -> Column:
    """One clock reading for a whole batch, as a literal."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, datetime):
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp")


def expiry(created_at: Column) -> Column:
    return created_at + F.expr(f"INTERVAL {fixed.RETENTION_HOURS} HOURS")


def clean_response(output: Column) -> Column:
    """A model's output without its reasoning traces; a default when there is none."""
    cleaned = F.coalesce(output, F.lit(fixed.NO_OUTPUT))
    for pattern in fixed.CLEANING_PATTERNS:
        cleaned = F.regexp_replace(cleaned, pattern, "")
    return strip(cleaned)


def ordered_text(items: Column, separator: str) -> Column:
    """Join collected ``struct(position, text)`` items in position order."""
    return F.array_join(F.transform(F.array_sort(items), lambda item: item["text"]), separator)

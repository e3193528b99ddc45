"""Names for landing and archived files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions.text import last_dot_part, split_extension, uuid_from
from paperloom.plans import spread

_COUNTERS_PER_SEGMENT = 65536


def landing_folder(catalog: str, schema: str) -> str:
    return fixed.LANDING_FORMAT.format(catalog=catalog, schema=schema)


def landing_paths(uploads: DataFrame, name: str, upload_key: Column, folder: str) -> DataFrame:
    """Add ``upload_id`` and ``landing_path``: a UUID and the name's last dot-part.

    The UUID follows from ``upload_key``, which must differ between uploads, so
    that a retried task gives the file the same name.
    """
    return uploads.withColumn("upload_id", uuid_from(upload_key.cast("string"))).withColumn(
        "landing_path",
        F.concat(F.lit(folder + "/"), "upload_id", F.lit("."), last_dot_part(F.col(name))),
    )


def archive_names(files: DataFrame, taken: DataFrame) -> DataFrame:
    """Add ``archive_name`` to files (``src_path, file_name``): a name no file in the
    archive (``taken``: ``file_name``) and no other file of the batch has.

    The first of a name keeps it if it is free; others get ``_1``, ``_2``, ...
    before the extension, passing over counters that are in use. Files of equal
    name are served in the order of their path's md5. A file's own name goes
    before a name that another file would get by counting.

    With f files of a name before it, a file gets counter f + u, where u counts
    the used counters below it. Both f and u are running sums, so a name that
    most files share is spread over tasks.
    """
    request = F.md5("src_path")
    asked = spread.running_sum(
        files.select("src_path", "file_name", request.alias("_order")),
        ["file_name"],
        F.conv(F.substring("_order", 1, 2), 16, 10).cast("long"),
        ["_order"],
        F.lit(1),
        "_served",
    ).select("src_path", "file_name", (F.col("_served") - 1).alias("_position"))

    occupied = (
        taken.select("file_name", F.lit(0).cast("long").alias("_counter"))
        .unionByName(_as_counted(taken))
        .unionByName(_as_counted(files))
    )
    asked_for = files.select("file_name").distinct()
    used = (
        spread.salted_join(occupied, asked_for, ["file_name"], F.col("_counter"), "left_semi")
        .repartition("file_name", "_counter")
        .distinct()
    )
    passed = spread.running_sum(
        used,
        ["file_name"],
        spread.by_number(F.col("_counter"), _COUNTERS_PER_SEGMENT),
        ["_counter"],
        F.lit(1),
        "_rank",
    ).select(
        "file_name",
        (F.col("_counter") - F.col("_rank") + 1).alias("_position"),
        F.lit(0).alias("_asks"),
        F.col("_counter").cast("string").alias("_tie"),
        F.lit(None).cast("string").alias("src_path"),
    )
    both = asked.select(
        "file_name",
        "_position",
        F.lit(1).alias("_asks"),
        F.col("src_path").alias("_tie"),
        "src_path",
    ).unionByName(passed)
    counted = spread.running_sum(
        both,
        ["file_name"],
        spread.by_number(F.col("_position"), _COUNTERS_PER_SEGMENT),
        ["_position", "_asks", "_tie"],
        1 - F.col("_asks"),
        "_skipped",
    ).filter(F.col("_asks") == 1)
    stem, extension = split_extension(F.col("file_name"))
    counter = F.col("_position") + F.col("_skipped")
    return counted.select(
        "src_path",
        "file_name",
        F.when(counter == 0, F.col("file_name"))
        .otherwise(F.concat(stem, F.lit("_"), counter.cast("string"), extension))
        .alias("archive_name"),
    )


def _as_counted(names: DataFrame) -> DataFrame:
    """Names that look counted, as (name without the counter, counter)."""
    stem, extension = split_extension(F.col("file_name"))
    ending = "_([1-9][0-9]{0,17})$"
    digits = F.regexp_extract(stem, ending, 1)
    return names.select(
        F.concat(F.regexp_replace(stem, ending, ""), extension).alias("file_name"),
        digits.alias("_digits"),
    ).filter(F.col("_digits") != "").select(
        "file_name", F.col("_digits").cast("long").alias("_counter")
    )

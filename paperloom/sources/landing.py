"""Files in the landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom import schemas

SUFFIX_GLOB = "*.[pP][dD][fF]"


def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every PDF below a folder, at any depth, suffix in any case.

    Listing is left to Spark; contents are read only where they are selected.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", SUFFIX_GLOB)
        .load(folder)
    )


def landing_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Files that appear below a folder, each once per checkpoint.

    A file that is gone when its batch is read, because it was archived before the batch
    is replayed, is passed over.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(schemas.LANDING_FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", SUFFIX_GLOB)
        .option("ignoreMissingFiles", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)

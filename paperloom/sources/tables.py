"""Stored tables: one folder per table, rows partitioned by the batch they came with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed_values as fixed
from paperloom import schemas
from paperloom.operators.ingest import PROCESSED


def table_path(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def read_table(spark: SparkSession, store: str, name: str, schema: T.StructType) -> DataFrame:
    """A table's rows with their ``batch_id``; empty when nothing was written yet."""
    stored = schemas.with_batch(schema)
    path = table_path(store, name)
    if not _exists(spark, path):
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).parquet(path)


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """The document table: the stored files that could be read."""
    files = read_table(spark, store, schemas.FILE_TABLE, schemas.FILE)
    return files.filter(F.col("outcome") == PROCESSED).select(*schemas.DOCUMENT.names, "batch_id")


def read_batch(
    spark: SparkSession, store: str, name: str, schema: T.StructType, batch_id: int
) -> DataFrame:
    """The rows of one batch, read from its partition alone."""
    stored = schemas.with_batch(schema)
    table = table_path(store, name)
    path = f"{table}/batch_id={batch_id}"
    if not _exists(spark, path):
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", table).parquet(path)


def write_batch(
    rows: DataFrame, store: str, name: str, batch_id: int, within: list[str] | None = None
) -> None:
    """Write a batch's rows in one job. Writing a batch again replaces its rows,
    also when there are none this time."""
    writer = rows.write.mode("overwrite")
    if within:
        writer = writer.partitionBy(*within)
    writer.parquet(f"{table_path(store, name)}/batch_id={batch_id}")


def append_rows(rows: DataFrame, schema: T.StructType, table: str) -> None:
    """Append rows to a catalog table, columns cast to its contract by name."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*columns).write.mode("append").format("parquet").saveAsTable(table)


def append_feedback(accepted: DataFrame, table: str = fixed.FEEDBACK_TABLE) -> None:
    append_rows(accepted, schemas.FEEDBACK, table)


def submit_feedback(
    spark: SparkSession,
    text: str,
    rating: int | None,
    comments: str,
    created_at: str,
    table: str = fixed.FEEDBACK_TABLE,
) -> None:
    """Insert one feedback row. Values are bound as parameters, never put into the SQL."""
    spark.sql(
        f"INSERT INTO {table} (text, rating, comments, created_at) "
        "VALUES (:text, CAST(:rating AS INT), :comments, CAST(:created_at AS TIMESTAMP))",
        args={
            "text": text,
            "rating": str(fixed.RATING_DEFAULT if rating is None else rating),
            "comments": comments,
            "created_at": created_at,
        },
    )


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists in the file system its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

"""Table contracts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from paperloom import fixed_values as fixed


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LONG, INT, STRING = T.LongType(), T.IntegerType(), T.StringType()
TIMESTAMP, BOOLEAN = T.TimestampType(), T.BooleanType()

LANDING_FILES = _struct(
    ("path", STRING),
    ("modificationTime", TIMESTAMP),
    ("length", LONG),
    ("content", T.BinaryType()),
)

DOCUMENT = _struct(
    ("id", LONG),
    ("document_uuid", STRING),
    ("upload_timestamp", TIMESTAMP),
    ("page_count", INT),
    ("word_count", INT),
    ("created_at", TIMESTAMP),
    ("expires_at", TIMESTAMP),
    ("text", STRING),
    ("file_name", STRING),
    ("file_path", STRING),
)

# Stored form of a file: its document or its error, told apart by the partition
# column ``outcome``.
FILE = T.StructType(
    [
        *DOCUMENT.fields,
        T.StructField("error_message", STRING, True),
        T.StructField("stack_trace", STRING, True),
        T.StructField("outcome", STRING, True),
    ]
)

CHUNK = _struct(
    ("id", LONG),
    ("document_id", LONG),
    ("chunk_index", INT),
    ("chunk_text", STRING),
    ("chunk_size", INT),
    ("created_at", TIMESTAMP),
    ("processed_for_embedding", BOOLEAN),
    ("document_uri", STRING),
)

PROCESSING_ERROR = _struct(
    ("id", LONG),
    ("error_timestamp", TIMESTAMP),
    ("file_name", STRING),
    ("file_path", STRING),
    ("error_message", STRING),
    ("stack_trace", STRING),
)

FEEDBACK = _struct(
    ("text", STRING),
    ("rating", INT),
    ("comments", STRING),
    ("created_at", TIMESTAMP),
)

CHUNK_EMBEDDING = _struct(
    ("document_id", LONG),
    ("chunk_index", INT),
    ("embedding", T.ArrayType(T.FloatType())),
)

# Folder of the file rows, of which documents are the readable part.
FILE_TABLE = "document_files"

CONTRACTS = {
    fixed.DOCUMENT_TABLE: DOCUMENT,
    fixed.CHUNK_TABLE: CHUNK,
    fixed.ERROR_TABLE: PROCESSING_ERROR,
    fixed.FEEDBACK_TABLE: FEEDBACK,
}


def with_batch(schema: T.StructType) -> T.StructType:
    """The stored form of a contract: rows carry the batch that wrote them."""
    return T.StructType([*schema.fields, T.StructField("batch_id", LONG, True)])


def create_tables(
    spark: SparkSession, database: str | None = None, store: str | None = None
) -> None:
    """Create the contract tables in the session's catalog where they are missing.

    Feedback is a table of the catalog. The ingested tables are the folders that
    ingest jobs write below ``store``; with it, they are opened in the database,
    partitioned by batch, so that readers can prune to the batches they want.
    """
    prefix = f"{database}." if database else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {prefix}`{fixed.FEEDBACK_TABLE}` "
        f"({_columns(FEEDBACK)}) USING parquet"
    )
    if store is not None:
        open_store(spark, store, database or spark.catalog.currentDatabase())


def open_store(spark: SparkSession, store: str, database: str) -> None:
    """Show the tables that ingest jobs write below ``store`` in a database.

    To be repeated after a batch, so that the catalog knows its partitions.
    Documents are a view of the files that could be read.
    """
    stored = {
        FILE_TABLE: (with_batch(FILE), "batch_id, outcome"),
        fixed.CHUNK_TABLE: (with_batch(CHUNK), "batch_id"),
        fixed.ERROR_TABLE: (with_batch(PROCESSING_ERROR), "batch_id"),
    }
    for name, (schema, parts) in stored.items():
        table = f"{database}.`{name}`"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({_columns(schema)}) USING parquet "
            f"PARTITIONED BY ({parts}) LOCATION '{store.rstrip('/')}/{name}'"
        )
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        spark.catalog.refreshTable(table)
    names = ", ".join([*DOCUMENT.names, "batch_id"])
    spark.sql(
        f"CREATE OR REPLACE VIEW {database}.`{fixed.DOCUMENT_TABLE}` AS "
        f"SELECT {names} FROM {database}.`{FILE_TABLE}` WHERE outcome = 'processed'"
    )


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

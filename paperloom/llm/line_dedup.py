"""Line dedup by overlapping windows of three lines.

Every three consecutive lines are hashed. A window that occurs again, in another
document or later in the same one, has its later occurrences removed: the lines
they cover, merged where occurrences overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import free_names

WIDTH = 3
SALTS = 8


def _windows(lines: Column, width: int) -> Column:
    """Digests of every ``width`` lines in a row, null where all of them are blank."""

    def digest(row: Column) -> Column:
        joined = F.concat_ws("\n", *[row[f"line{k}"] for k in range(width)])
        blank = F.trim(F.translate(joined, "\n\t\r", "   ")) == ""
        return F.when(~blank, F.unhex(F.md5(joined)))

    size = F.size(lines)
    shifted = [F.slice(lines, k + 1, size).alias(f"line{k}") for k in range(width)]
    runs = F.slice(F.arrays_zip(*shifted), 1, F.greatest(size - (width - 1), F.lit(0)))
    return F.transform(runs, digest)


def remove_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    lines_removed: str = "lines_removed",
    lines_total: str = "lines_total",
) -> DataFrame:
    """The documents with ``text`` cleaned, and the positions removed and the number of
    lines before, in two more columns (existing ones of these names are replaced).

    Of a window's occurrences the first by (doc_id, position) stays whole; null ids
    come first. Rows alike in id and text are one document and are treated alike.
    Documents of fewer than ``width`` lines and windows of blank lines stay as they
    are; so do null and empty texts. An empty table gives an empty table.

    Scale: windows are grouped by digest with partial aggregation; the join back is
    salted, since one window may occur in a third of all documents; the cell that
    is collected is one document's own positions. The text is shuffled once.
    """
    docs = docs.drop(lines_removed, lines_total)
    key, parts, found, first, salt, gone = free_names(
        docs, "_text_key", "_lines", "_window", "_first", "_salt", "_gone"
    )
    keyed = docs.withColumns(
        {key: F.xxhash64(F.col(text)), parts: F.split(F.col(text), "\n", -1)}
    )
    at = F.struct(F.col(doc_id).alias("id"), F.col(key).alias("key"), F.col("pos").alias("pos"))
    windows = keyed.select(
        doc_id, key, F.posexplode(_windows(F.col(parts), width))
    ).filter(F.col("col").isNotNull())
    windows = windows.select(F.col("col").alias(found), at.alias("at"))
    repeated = (
        windows.groupBy(found)
        .agg(F.min("at").alias(first), F.max("at").alias("_last"))
        .filter(F.col(first) != F.col("_last"))
        .select(found, first, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    )
    later = (
        windows.withColumn(salt, F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
        .join(repeated, [found, salt])
        .filter(F.col("at") > F.col(first))
        .groupBy(F.col("at.id").alias("_id"), F.col("at.key").alias("_key"))
        .agg(F.collect_set("at.pos").alias(gone))
    )
    joined = keyed.drop(text).join(
        later, keyed[doc_id].eqNullSafe(later["_id"]) & keyed[key].eqNullSafe(later["_key"]), "left"
    )
    covered = F.array_distinct(
        F.flatten(F.transform(gone, lambda p: F.sequence(p, p + (width - 1))))
    )
    size = F.size(parts)
    stays = F.array_except(F.sequence(F.lit(0), size - 1), F.col(lines_removed))
    clean = F.transform(stays, lambda i: F.get(F.col(parts), i))
    return (
        joined.withColumns(
            {
                lines_removed: F.array_sort(F.coalesce(covered, F.array().cast("array<int>"))),
                lines_total: F.when(F.col(parts).isNull(), 0).otherwise(size),
            }
        )
        .withColumn(
            text,
            F.array_join(F.when(F.size(lines_removed) == 0, F.col(parts)).otherwise(clean), "\n"),
        )
        .select(*docs.columns, lines_removed, lines_total)
    )

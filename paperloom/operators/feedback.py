"""User feedback rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions.text import as_timestamp


def feedback_rows(submitted: DataFrame, created_at) -> DataFrame:
    """Typed feedback (``text, rating, comments``) with its other columns.

    A missing rating is the default one. What is no whole number has a null rating
    and is not accepted, nor is a rating out of bounds.
    """
    given = F.trim(F.col("rating").cast("string"))
    whole = F.when(given.rlike(r"^[+-]?\d+(\.0*)?$"), given.try_cast("double").try_cast("int"))
    rating = F.when(F.col("rating").isNull(), F.lit(fixed.RATING_DEFAULT)).otherwise(whole)
    own = ("text", "rating", "comments", "created_at", "accepted")
    return submitted.select(
        *[name for name in submitted.columns if name not in own],
        F.col("text").cast("string").alias("text"),
        rating.alias("rating"),
        F.coalesce(F.col("comments").cast("string"), F.lit("")).alias("comments"),
        as_timestamp(created_at).alias("created_at"),
        F.coalesce(rating.between(fixed.RATING_MIN, fixed.RATING_MAX), F.lit(False)).alias(
            "accepted"
        ),
    )


def accepted_feedback(submitted: DataFrame, created_at) -> DataFrame:
    return feedback_rows(submitted, created_at).filter("accepted").drop("accepted")


def rejected_feedback(submitted: DataFrame, created_at) -> DataFrame:
    return feedback_rows(submitted, created_at).filter("NOT accepted").drop("accepted")

"""Keep the richest copy of each posting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_longest(df: DataFrame, keys: Sequence[str] = ("company", "title"),
                 text: str = "description_clean",
                 ties: Sequence[str] = ("job_id", "url", "source")) -> DataFrame:
    """One row per key, the one with the longest text; null keys count as equal.

    `row_number() = 1` is planned with a group limit below the shuffle, so each task sends at most
    one row per key however hot the key is. `ties` makes the choice repeatable.
    """
    richest = Window.partitionBy(*keys).orderBy(
        F.length(text).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties],
        F.col(text).asc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(richest)) \
        .filter(F.col("_rank") == 1).drop("_rank")


def dedupe_counts(df: DataFrame, keys: Sequence[str] = ("company", "title")) -> DataFrame:
    """Rows before and after `keep_longest`, without running it.

    Grouping first means the hot key arrives already counted.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
                       F.count("*").alias("rows_after"))

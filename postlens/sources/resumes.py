"""Plain-text résumés, one per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.text import strip_ends
from postlens.operators.match import MIN_RESUME_CHARS


def valid_text(c: Column) -> Column:
    """Drop bytes that are not UTF-8. Valid text is kept as it is, U+FFFD included."""
    return F.when(F.is_valid_utf8(c), c) \
        .otherwise(F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit("")))


def read_resumes(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(resume_id, text): file name without its ending, whole text."""
    return (
        spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
        .select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("resume_id"),
                valid_text(F.col("value")).alias("text"))
    )


def _chars() -> Column:
    return F.length(strip_ends(F.coalesce("text", F.lit(""))))


def usable(df: DataFrame, min_chars: int = MIN_RESUME_CHARS) -> DataFrame:
    return df.filter(_chars() >= min_chars)


def too_short(df: DataFrame, min_chars: int = MIN_RESUME_CHARS) -> DataFrame:
    """Rejected résumés with their length."""
    return df.filter(_chars() < min_chars).select("resume_id", _chars().alias("chars"))

"""Skill demand per period, as a batch table and as a table that a stream keeps up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens import schemas
from postlens.functions.labels import percent
from postlens.streaming.table import KeyedTable


def _labelled(df: DataFrame, ts: str, skills: str, period: str) -> DataFrame:
    return df.select(F.date_trunc(period, F.col(ts)).alias("period"), F.col(skills).alias("skills"))


def skill_trend(df: DataFrame, ts: str = "scraped_at", skills: str = "skills_extracted",
                period: str = "month") -> DataFrame:
    """(period, skill, postings, pct, place, place_change): demand, share of the period's postings,
    rank in the period, and how far the rank moved since the skill's previous period.

    Postings are counted per (period, label set) first; both aggregates start from those counts.
    The windows run over one row per period and skill.
    """
    sets = _labelled(df, ts, skills, period).filter(F.col("period").isNotNull()) \
        .groupBy("period", "skills").agg(F.count("*").alias("n"))
    totals = sets.groupBy("period").agg(F.sum("n").alias("total"))
    counts = sets.select("period", "n", F.explode_outer("skills").alias("skill")) \
        .filter(F.col("skill").isNotNull()).groupBy("period", "skill") \
        .agg(F.sum("n").alias("postings"))
    in_period = Window.partitionBy("period").orderBy(F.desc("postings"), "skill")
    over_time = Window.partitionBy("skill").orderBy("period")
    return (
        counts.join(totals, "period")
        .withColumn("place", F.row_number().over(in_period))
        .withColumn("place_change", F.lag("place").over(over_time) - F.col("place"))
        .select("period", "skill", "postings",
                percent(F.col("postings"), F.col("total")).alias("pct"), "place", "place_change")
    )


def period_counts(df: DataFrame, ts: str = "scraped_at", skills: str = "skills_extracted",
                  period: str = "month") -> DataFrame:
    """(period, skill, postings) per calendar period."""
    return (
        _labelled(df, ts, skills, period)
        .select("period", F.explode_outer("skills").alias("skill"))
        .filter(F.col("skill").isNotNull()).groupBy("period", "skill").agg(F.count("*").alias("postings"))
    )


def window_counts(df: DataFrame, ts: str = "scraped_at", skills: str = "skills_extracted",
                  length: str = "7 days") -> DataFrame:
    """(period, skill, postings) per fixed window, which is named by its start."""
    return (
        df.select(F.col(ts).alias("ts"), F.explode_outer(skills).alias("skill"))
        .filter(F.col("skill").isNotNull())
        .groupBy(F.window("ts", length).alias("window"), "skill")
        .agg(F.count("*").alias("postings"))
        .select(F.col("window.start").alias("period"), "skill", "postings")
    )


def trend_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """Running counts, in buckets by period: a batch rewrites those of the periods it has rows of."""
    return KeyedTable(
        spark, path, schemas.TREND, ["period"],
        lambda rows: rows.groupBy("bucket", "period", "skill").agg(F.sum("postings").alias("postings")),
        buckets)


def running_trend(df: DataFrame, table: KeyedTable, checkpoint: str,
                  counts: Callable[[DataFrame], DataFrame] = period_counts) -> StreamingQuery:
    """Keep `table` up with a stream: each batch is counted and its counts are added to the periods
    they belong to.

    The table itself is the state, so nothing has to be held open or forgotten: no row is too late to
    count, a period that a batch does not touch is not written again, and a batch that is run again
    after a failure is not added twice, as the table knows it by its id.
    """
    return (
        df.writeStream.foreachBatch(lambda batch, batch_id: table.merge(counts(batch), batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

"""Demand aggregates over tagged postings.

Every count is a hash aggregate that combines map-side, so the shuffles carry at most one row per
skill, source or label set and task.

Unwanted groups are dropped by a count after the aggregate, and arrays are exploded with the outer
form. A filter on the tagged columns, or the one Spark infers for a plain explode, would be pushed
below the projection that makes them and repeat the whole tagging there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import schemas
from postlens.functions.automaton import skill_spans
from postlens.functions.labels import count_label, percent
from postlens.functions.skills import match_spans
from postlens.taxonomy import ROLE_SKILLS, Taxonomy

SKILLS = "skills_extracted"


def mentions(df: DataFrame, skills: str = SKILLS) -> DataFrame:
    """One row per posting and skill; a posting without skills gives a null."""
    return df.select(F.explode_outer(skills).alias("skill"))


def skill_counts(df: DataFrame, skills: str = SKILLS) -> DataFrame:
    """Postings per skill."""
    return mentions(df, skills).groupBy("skill").agg(F.count("skill").alias("postings")) \
        .filter(F.col("postings") > 0)


def ranked_skills(df: DataFrame, skills: str = SKILLS) -> DataFrame:
    return skill_counts(df, skills).orderBy(F.desc("postings"), "skill")


def top_skills(df: DataFrame, n: int = 20, skills: str = SKILLS) -> DataFrame:
    """The n most wanted skills with their share of all postings and a display label."""
    total = df.agg(F.count("*").alias("n")).scalar()
    pct = percent(F.col("postings"), total)
    return ranked_skills(df, skills).limit(n).select(
        "skill", "postings", pct.alias("pct"), count_label(F.col("postings"), pct).alias("label"))


def with_category(counts: DataFrame, categories: DataFrame, default: str = "Other") -> DataFrame:
    """Look each skill's category up. The taxonomy is a driver-side constant, so it is broadcast."""
    return counts.join(F.broadcast(categories), "skill", "left") \
        .withColumn("category", F.coalesce("category", F.lit(default)))


def category_totals(df: DataFrame, categories: DataFrame, skills: str = SKILLS) -> DataFrame:
    """Mentions per category."""
    return (
        with_category(skill_counts(df, skills), categories)
        .groupBy("category").agg(F.sum("postings").alias("mentions"))
        .orderBy(F.desc("mentions"), "category")
    )


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """Postings per source, nulls left out."""
    return (
        df.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("source"))
        .agg(F.count("*").alias("postings")).orderBy(F.desc("postings"), "source")
    )


def experience_histogram(df: DataFrame, years: str = "exp_min_years") -> DataFrame:
    """Postings per minimum years, with how many of all postings had a band."""
    counts = df.groupBy(F.col(years).cast("int").alias("years")) \
        .agg(F.count(years).alias("postings"), F.count("*").alias("_n"))
    return (
        counts.withColumn("parsed", counts.agg(F.sum("postings")).scalar())
        .withColumn("total", counts.agg(F.sum("_n")).scalar())
        .filter(F.col("postings") > 0).drop("_n").orderBy("years")
    )


def pair_table(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per side of each pair, numbered in list order."""
    rows = [(2 * i + j, side, skill) for i, pair in enumerate(pairs)
            for j, (side, skill) in enumerate(zip("ab", pair))]
    return spark.createDataFrame(rows, schemas.PAIR)


def head_to_head(df: DataFrame, pairs: Sequence[tuple[str, str]],
                 skills: str = SKILLS) -> DataFrame:
    """Counts for the listed skills, in list order, repeats kept, 0 for a skill never seen."""
    wanted = sorted({s for pair in pairs for s in pair})
    counts = mentions(df, skills).filter(F.col("skill").isin(wanted)) \
        .groupBy("skill").agg(F.count("skill").alias("postings"))
    return (
        pair_table(df.sparkSession, pairs).join(counts, "skill", "left")
        .select("pos", "side", "skill", F.coalesce("postings", F.lit(0)).alias("postings"))
        .orderBy("pos")
    )


def cooccurrence(df: DataFrame, n: int = 15, skills: str = SKILLS) -> DataFrame:
    """Full symmetric count matrix of the top n skills, diagonal and zeros included.

    Postings are first counted by skill set. The ranking and the pairs both start from these counts
    and share their exchange. Pairs are spread from the distinct sets of top skills, never from
    postings, and such a set has at most n members.
    """
    sets = df.select(F.col(skills).alias("skills")).groupBy("skills").agg(F.count("*").alias("n"))
    ranked = (
        sets.select("n", F.explode_outer("skills").alias("skill"))
        .groupBy("skill").agg(F.sum("n").alias("postings")).filter(F.col("skill").isNotNull())
        .orderBy(F.desc("postings"), "skill").limit(n)
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("postings"), "skill"))).alias("s"))
        .select(F.transform("s", lambda x: x["skill"])).scalar()
    )
    carried = sets.select("n", F.array_intersect(ranked, F.col("skills")).alias("skills")) \
        .groupBy("skills").agg(F.sum("n").alias("n"))
    pairs = (
        carried.select("skills", "n", F.explode_outer("skills").alias("a"))
        .select("n", "a", F.explode_outer("skills").alias("b"))
        .groupBy("a", "b").agg(F.sum("n").alias("postings"))
    )
    grid = (
        df.sparkSession.range(1).select(ranked.alias("ranked"))
        .select("ranked", F.posexplode("ranked").alias("rank_a", "a"))
        .select("rank_a", "a", F.posexplode("ranked").alias("rank_b", "b"))
    )
    # n * n rows on either side
    return (
        grid.join(F.broadcast(pairs), ["a", "b"], "left")
        .select("rank_a", "rank_b", "a", "b", F.coalesce("postings", F.lit(0)).alias("postings"))
        .orderBy("rank_a", "rank_b")
    )


def cooccurrence_matrix(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same matrix with one column per skill; `names` are the n top skills."""
    return cells.groupBy("rank_a", "a").pivot("b", list(names)).agg(F.sum("postings")) \
        .orderBy("rank_a").drop("rank_a")


def hierarchy(df: DataFrame, categories: DataFrame, skills: str = SKILLS) -> DataFrame:
    """Category -> skill tree: leaf = count; parent = sum, coloured by count-weighted mean."""
    c = F.col("postings")
    return (
        with_category(skill_counts(df, skills), categories)
        .rollup("category", "skill")
        .agg(F.grouping_id().alias("level"), F.sum(c).alias("postings"),
             (F.sum(c * c) / F.sum(c)).alias("color"))
        .filter(F.col("level") < 3)
        .select("category", "skill", (F.col("level") == 1).alias("is_parent"), "postings", "color")
        .orderBy("category", F.col("skill").asc_nulls_first())
    )


def headline_numbers(df: DataFrame, company: str = "company",
                     count: str = "skill_count") -> DataFrame:
    """Postings, distinct companies (null not counted), mean skills per posting."""
    per_company = df.groupBy(company).agg(F.count("*").alias("n"), F.sum(count).alias("s"),
                                          F.count(count).alias("c"))
    return per_company.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.count(company).alias("companies"),
        F.bround(F.try_divide(F.sum("s"), F.sum("c")), 1).alias("mean_skills"))


def run_summary(df: DataFrame) -> DataFrame:
    """Share of postings without skills and with an experience band, and mean skills."""
    no_skill = F.col("skill_count") == 0
    band = F.col("exp_min_years").isNotNull()

    def share(cond: Column) -> Column:
        return F.bround(F.avg(cond.cast("int")) * 100, 1)

    return df.agg(
        F.count("*").alias("postings"),
        F.count_if(no_skill).alias("zero_skill"), share(no_skill).alias("zero_skill_pct"),
        F.count_if(band).alias("with_band"), share(band).alias("with_band_pct"),
        F.bround(F.avg("skill_count"), 1).alias("mean_skills"))


def truncation_audit(df: DataFrame, has: str, lacks: str, skills: str = SKILLS) -> DataFrame:
    """Postings with one skill but not the other, by whether their text was cut off."""
    wanted = F.array_contains(skills, has) & ~F.array_contains(skills, lacks)
    return (
        df.groupBy("description_is_truncated").agg(F.count_if(wanted).alias("postings"))
        .filter(F.col("postings") > 0).orderBy("description_is_truncated")
    )


def span_audit(df: DataFrame, text: str, patterns: list[str], around: int = 30) -> DataFrame:
    """Distinct contexts in which a skill's patterns hit, most frequent first."""
    return (
        df.select(F.explode_outer(match_spans(F.col(text), patterns, around)).alias("span"))
        .groupBy("span").agg(F.count("span").alias("hits"))
        .filter(F.col("hits") > 0).orderBy(F.desc("hits"), "span")
    )


def skill_span_audit(df: DataFrame, text: str, taxonomy: Taxonomy = ROLE_SKILLS,
                     around: int = 30) -> DataFrame:
    """(skill, span, hits): the distinct contexts in which each skill of a taxonomy hits."""
    return skill_spans(df, F.col(text), taxonomy, around).groupBy("skill", "span") \
        .agg(F.count("*").alias("hits")).orderBy("skill", F.desc("hits"), "span")


def merge_counts(raw: DataFrame, keys: Sequence[str] = ("company", "title"),
                 source: str = "source") -> DataFrame:
    """(level, source, postings): rows per source, all rows, and rows left once copies are merged."""
    per_key = raw.groupBy(source, *keys).agg(F.count("*").alias("n"))
    per_source = per_key.groupBy(F.col(source).alias("source")).agg(F.sum("n").alias("postings"))
    merged = per_key.groupBy(*keys).agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count("*").alias("after"))
    totals = merged.select(F.explode(F.create_map(
        F.lit("all"), F.col("before"), F.lit("merged"), F.col("after"))).alias("level", "postings"))
    return per_source.withColumn("level", F.lit("source")) \
        .unionByName(totals.withColumn("source", F.lit(None).cast("string")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, such as the cluster numbers on offer."""
    return df.select(column).distinct().orderBy(column)

"""Résumés against the clustered table, up to the prompts to send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.skills import with_skills
from postlens.operators.match import TOP_MATCHES, Matching, spread_join
from postlens.operators.reports import PROMPT_COLUMNS, prompt
from postlens.session import stage
from postlens.sources.resumes import usable
from postlens.taxonomy import ROLE_SKILLS, Taxonomy


def resume_skills(resumes: DataFrame, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """Skills on the résumé text as it is. Its line breaks bound the patterns that look ahead."""
    return with_skills(resumes, F.col("text"), taxonomy)


def gap_prompts(resumes: DataFrame, postings: DataFrame, as_of: Column,
                taxonomy: Taxonomy = ROLE_SKILLS, n: int = TOP_MATCHES) -> DataFrame:
    """Prompts for the n best postings of each usable résumé.

    Ids are ranked first and texts come late. The postings' skills are staged once, so their texts are
    tagged once; the texts of those that were picked join the picks, which are one list per set of
    skills and not per résumé. A posting that many sets pick is dealt over tasks. Résumé texts are
    staged beside their skills and move once, to the list of their set.
    """
    skills = stage(postings.select("posting_id", "skills_extracted"), "posting-skills")
    found = Matching(resume_skills(usable(resumes), taxonomy), skills, n, keep=["text"])
    picks = stage(found.by_set().select(*found.key, "place", "posting_id"), "picks")
    counts = picks.groupBy("posting_id").agg(F.count("*").alias("n"))
    texts = [c for c in PROMPT_COLUMNS if c != "skills_extracted"]
    picked = postings.select("posting_id", *texts).join(counts.select("posting_id"), "posting_id", "left_semi") \
        .join(skills, "posting_id")
    lists = spread_join(picks, picked, ["posting_id"], "place", counts) \
        .groupBy(*found.key).agg(F.collect_list(F.struct("place", "posting_id", *PROMPT_COLUMNS)).alias("picked"))
    return (
        found.to_resumes(lists).withColumnRenamed("text", "_resume")
        .select("resume_id", "_resume", F.inline("picked"))
        .select("resume_id", "place", "posting_id", prompt(F.col("_resume"), as_of).alias("prompt"))
    )

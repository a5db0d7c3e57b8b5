"""Raw postings to the clean table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.skills import with_tags
from postlens.functions.text import looks_truncated, or_empty, search_text, with_clean_text
from postlens.operators.dedupe import keep_longest
from postlens.operators.prefix import HEADS, company_prefixes, strip_prefixes, with_heads
from postlens.session import stage
from postlens.taxonomy import ROLE_SKILLS, Taxonomy


def to_clean(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Row-local part: rename, clean the description, flag cut-off text. Titles stay as they are.
    Columns named in `keep` pass through."""
    cut = looks_truncated(F.col("description_snippet"))
    cleaned = with_clean_text(raw, "description_snippet", "description_clean")
    return cleaned.select(
        "source", F.col("query").alias("search_query"), "job_id",
        or_empty(F.col("title")).alias("title"), "company", "location", "description_clean",
        cut.alias("description_is_truncated"), "posted_date", "url", *keep)


def tag(df: DataFrame, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """Skills and experience from title plus description."""
    return with_tags(df, search_text(F.col("title"), F.col("description_clean")), taxonomy)


def clean_postings(raw: DataFrame, taxonomy: Taxonomy = ROLE_SKILLS,
                   dedupe_first: bool = False) -> DataFrame:
    """The clean table.

    Intros are stripped before copies are merged, as repeats of one posting share their whole text
    and so lose all but its last word. `dedupe_first` merges first instead, which keeps them.

    The cleaned rows are staged once with the digests of their openings, so the first step of the
    prefix search reads no text. Tagging comes after the merge, so merged copies are never tagged.
    """
    cleaned = to_clean(raw)
    if dedupe_first:
        cleaned = keep_longest(cleaned)
    cleaned = stage(with_heads(cleaned), "cleaned")
    stripped = strip_prefixes(cleaned, company_prefixes(cleaned)).drop(*HEADS)
    if not dedupe_first:
        stripped = keep_longest(stripped)
    return tag(stripped, taxonomy)


def longest_first(df: DataFrame) -> list[Column]:
    """Order of the clean table: longest description first, ties by key."""
    return [F.length("description_clean").desc(), F.col("company").asc_nulls_last(),
            F.col("title").asc_nulls_last()]

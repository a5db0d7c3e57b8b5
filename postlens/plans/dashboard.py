"""Every aggregate of the market overview, from one pass over the clean table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from postlens.operators import demand
from postlens.session import stage
from postlens.taxonomy import ROLE_PAIRS, ROLE_SKILLS, Taxonomy, category_table


def overview(clean: DataFrame, taxonomy: Taxonomy = ROLE_SKILLS,
             pairs: Mapping[str, Sequence[tuple[str, str]]] = ROLE_PAIRS) -> dict[str, DataFrame]:
    """Name -> aggregate. The columns the aggregates read are staged, without the texts."""
    narrow = stage(clean.select("source", "company", "skills_extracted", "skill_count",
                                "exp_min_years"), "overview")
    categories = category_table(clean.sparkSession, taxonomy)
    tables = {
        "headline": demand.headline_numbers(narrow),
        "run_summary": demand.run_summary(narrow),
        "top_skills": demand.top_skills(narrow),
        "categories": demand.category_totals(narrow, categories),
        "sources": demand.source_counts(narrow),
        "experience": demand.experience_histogram(narrow),
        "cooccurrence": demand.cooccurrence(narrow),
        "hierarchy": demand.hierarchy(narrow, categories),
    }
    for title, listed in pairs.items():
        tables[title] = demand.head_to_head(narrow, listed)
    return tables

"""Display text for rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display formats and fallbacks.
NO_SKILLS = "none reliably extracted"
NO_MATCH = "-"


def text_or_none(c: Column) -> Column:
    """Null prints as 'None' in the rendered documents."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def skills_text(skills: Column, fallback: str = "") -> Column:
    return F.when(F.size(skills) > 0, F.array_join(skills, ", ")).otherwise(F.lit(fallback))


def skills_preview(skills: Column, n: int = 4) -> Column:
    return F.array_join(F.slice(skills, 1, n), ", ")


def count_label(count: Column, pct: Column) -> Column:
    return F.concat(count.cast("string"), F.lit(" ("), pct.cast("string"), F.lit("%)"))


def cluster_label(cluster: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


def posting_label(title: Column, company: Column) -> Column:
    return F.concat(text_or_none(title), F.lit(" @ "), text_or_none(company))


def match_label(title: Column, company: Column, matched: Column) -> Column:
    return F.concat(posting_label(title, company), F.lit(" -- "), matched.cast("string"),
                    F.lit(" skills matched"))


def listing_line(index: Column, title: Column, company: Column, cluster: Column,
                 skills: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), posting_label(title, company),
                    F.lit(" (cluster "), text_or_none(cluster), F.lit(") -- "),
                    skills_preview(skills))


def file_stem(title: Column, n: int = 40) -> Column:
    return F.left(F.regexp_replace(title, r"[^\p{L}\p{N}]", "_"), F.lit(n))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Half-even percentage. Divides first, so the last bit agrees with part / whole * 100."""
    return F.bround(part.cast("double") / whole.cast("double") * 100, places)

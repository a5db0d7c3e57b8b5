"""Prompt and report documents as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.labels import NO_SKILLS, file_stem, listing_line, skills_text, text_or_none
from postlens.session import stage

# The prompt text, with the places filled per row in braces.
PROMPT = """You are a career advisor helping a candidate assess their fit for a specific job posting. Be honest and specific, not generically encouraging.

IMPORTANT: Today's actual date is {month}. Use this as ground truth for any date reasoning (e.g. whether a listed internship or degree date is in the past, present, or future). Do not assume or guess the current date from anything else.

## Candidate's Resume

{resume}

## Target Job Posting

Title: {title}
Company: {company}
Location: {location}
Extracted skills mentioned in posting: {skills}

Full description:
{description}

## Your Task

Produce a gap analysis with these exact sections:

### Strong Matches
Specific skills/experience from the resume that directly match what this posting wants. Cite the actual resume content, don't just restate the job posting.

### Real Gaps
Skills/experience the posting wants that the resume doesn't clearly demonstrate. Be specific -- not "needs more ML experience" but "posting emphasizes production RAG pipelines; resume shows model training but no deployment/serving experience."

### Overstated or Ambiguous
Anything on the resume that's phrased vaguely enough that a reviewer might not credit it, even if the underlying experience might actually count.

### Concrete Next Steps
2-4 specific, actionable things the candidate could do to close the biggest gaps -- a project to build, a concept to learn, or how to rephrase existing experience to surface it better. Not generic advice like "learn more about AI."

### Overall Fit
One honest paragraph: is this a reasonable role to apply for now, a stretch worth trying anyway, or not yet a good match -- and why."""

# The report document and its file name.
REPORT = """# Gap Analysis: {title} @ {company}

**Generated:** {generated}
**Resume used:** {resume_name}
**Job location:** {location}
**Job posting URL:** {url}

---

{analysis}
"""
REPORT_FILE = "gap_analysis_{stem}_{stamp}.md"


def fill(template: str, **places: Column) -> Column:
    """Template with {name} places as one concat over the given columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        opened = min((i for i in (rest.find("{%s}" % p) for p in places) if i >= 0), default=-1)
        if opened < 0:
            parts.append(F.lit(rest))
            break
        closed = rest.index("}", opened)
        if opened:
            parts.append(F.lit(rest[:opened]))
        parts.append(places[rest[opened + 1:closed]])
        rest = rest[closed + 1:]
    return F.concat(*parts)


#: Positions that are found without sorting the table.
FIRST = 10_000

#: What a prompt takes from a posting.
PROMPT_COLUMNS = ["title", "company", "location", "skills_extracted", "description_clean"]


def prompt(resume_text: Column, as_of: Column) -> Column:
    """Gap-analysis prompt for a row that holds a posting; `as_of` is the date it is written on."""
    return fill(
        PROMPT, month=F.date_format(as_of, "MMMM yyyy"), resume=resume_text,
        title=text_or_none(F.col("title")), company=text_or_none(F.col("company")),
        location=text_or_none(F.col("location")),
        skills=skills_text(F.col("skills_extracted"), NO_SKILLS),
        description=text_or_none(F.col("description_clean")))


def report_documents(df: DataFrame) -> DataFrame:
    """(path, content) for rows holding a posting, `analysis`, `resume_name` and `generated_at`."""
    when = F.col("generated_at")
    content = fill(
        REPORT, title=text_or_none(F.col("title")), company=text_or_none(F.col("company")),
        generated=F.date_format(when, "yyyy-MM-dd HH:mm"), resume_name=F.col("resume_name"),
        location=text_or_none(F.col("location")), url=F.coalesce("url", F.lit("n/a")),
        analysis=F.col("analysis"))
    path = fill(REPORT_FILE, stem=file_stem(F.col("title")),
                stamp=F.date_format(when, "yyyyMMdd_HHmmss"))
    return df.select(path.alias("path"), content.alias("content"))


def posting_list(df: DataFrame, order: list[Column | str], n: int = 30) -> DataFrame:
    """The first n postings as numbered display lines."""
    # the window has no partition key, but sees n rows only
    numbered = df.orderBy(*order).limit(n) \
        .withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.select("index", listing_line(
        F.col("index"), F.col("title"), F.col("company"), F.col("cluster"),
        F.col("skills_extracted")).alias("line"))


def prompts_for(posting: DataFrame, resumes: DataFrame, as_of: Column) -> DataFrame:
    """One prompt per résumé for one chosen posting, a table of at most one row. It reaches the
    résumés as a constant, so no text is shuffled."""
    chosen = posting.select(F.struct(*PROMPT_COLUMNS).alias("p")).scalar()
    return resumes.withColumn("_p", chosen).filter(F.col("_p").isNotNull()) \
        .select("resume_id", F.col("text").alias("_resume"), "_p.*") \
        .select("resume_id", prompt(F.col("_resume"), as_of).alias("prompt"))


def find_posting(df: DataFrame, title: str, company: str, order: list[Column | str]) -> DataFrame:
    """The first posting with this title and company."""
    return df.filter((F.col("title") == title) & F.col("company").eqNullSafe(company)) \
        .orderBy(*order).limit(1)


def posting_at(df: DataFrame, index: int, order: list[Column | str]) -> DataFrame:
    """The posting at a position of the ordered table.

    Up to `FIRST` each task keeps its first rows only. For a later one the table is sorted into ranges;
    their row counts tell which range holds the position, and only that one is looked through. The
    ranges' limits come from a pass of their own, so the table is staged before.
    """
    if index < FIRST:
        return df.orderBy(*order).offset(index).limit(1)
    ranged = stage(stage(df, "ordered").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()),
                   "ranges")
    for r in ranged.groupBy("_range").count().orderBy("_range").toLocalIterator():
        if index < r["count"]:
            return ranged.filter(F.col("_range") == r["_range"]).drop("_range") \
                .orderBy(*order).offset(index).limit(1)
        index -= r["count"]
    return df.limit(0)

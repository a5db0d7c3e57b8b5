"""Cleaning, tagging, prefix and merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.catalog import checks, inputs
from postlens.catalog.registry import query
from postlens.functions import skills as skill_fn
from postlens.functions import text
from postlens.operators import dedupe, prefix
from postlens.plans.wrangle import clean_postings as clean_plan
from postlens.plans.wrangle import tag, to_clean


def role_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_clean(inputs.role_postings(spark, sf_dir))


def role_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag(role_clean(spark, sf_dir))


def document_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.document_postings(spark, sf_dir)
    found = text.search_text(F.col("title"), F.col("description_clean"))
    return skill_fn.with_skills(docs, found, inputs.PROSE_TERMS, long_texts=True)


def flat(df: DataFrame) -> DataFrame:
    """Comparable form: skills as text, counts as bigint."""
    return df.withColumn("skills_extracted", F.array_join("skills_extracted", "|")) \
        .withColumn("skill_count", F.col("skill_count").cast("bigint"))


FLAT_SQL = "* REPLACE (array_to_string(skills_extracted, '|') AS skills_extracted, " \
    "CAST(skill_count AS BIGINT) AS skill_count)"


@query(f"SELECT page_id, {checks.clean_sql('html')} AS text FROM pages")
def clean_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.texts(spark, sf_dir, "pages")
    return text.with_clean_text(pages, "html", "text").select("page_id", "text")


FANCY = "replace(replace(replace(replace(text, '.', '…'), ',', '—'), 'e ', '’ '), ' a', ' “')"


@query(f"""SELECT doc_id, replace(replace(replace(replace({FANCY}, '…', '...'), '—', '-'),
  '’', ''''), '“', '"') AS text FROM documents""")
def plain_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", text.plain_punctuation(F.expr(FANCY)).alias("text"))


INJECTED = """concat('Intro. THIS job is with Acme, a myGwork partner.', chr(10), split_part(text, '.', 1),
  chr(10), 'Please do not contact the recruiter directly. ', text)"""


@query(f"""SELECT doc_id, regexp_replace({INJECTED},
  '(?is)This job is with .*?myGwork.*?Please do not contact the recruiter directly\\.?', ' ', 'g')
  AS text FROM documents""")
def boilerplate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(INJECTED).alias("text")) \
        .withColumn("text", text.drop_boilerplate(F.col("text")))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.texts(spark, sf_dir, "pages").select(
        "page_id", text.strip_tags(F.col("html")).alias("text"))


SPACED = "concat(chr(9), replace(replace(text, ' t', concat(chr(160), '  t')), 'e ', concat('e', " \
    "chr(8195))), chr(10))"


@query(f"SELECT doc_id, trim(regexp_replace({SPACED}, '{checks.SPACE}+', ' ', 'g')) AS text "
       "FROM documents")
def space_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(
        F.lit("\t"), F.replace(F.replace("text", F.lit(" t"), F.lit("\xa0  t")), F.lit("e "),
                               F.lit("e ")), F.lit("\n"))
    return inputs.texts(spark, sf_dir, "documents").select(
        "doc_id", text.collapse_spaces(spaced).alias("text"))


@query(f"SELECT doc_id, {checks.truncated_sql('text')} AS cut FROM documents")
def truncate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.texts(spark, sf_dir, "documents").select(
        "doc_id", text.looks_truncated(F.col("text")).alias("cut"))


@query(f"WITH {checks.ROLE_CLEAN} SELECT * FROM cleaned")
def clean_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_clean(spark, sf_dir)


@query(f"""{checks.DOCUMENT_TAGGED} SELECT posting_id,
  array_to_string(skills_extracted, '|') AS skills_extracted,
  CAST(skill_count AS BIGINT) AS skill_count FROM t""")
def skill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(document_tagged(spark, sf_dir)).select(
        "posting_id", "skills_extracted", "skill_count")


@query(f"""{checks.ROLE_TAGGED} SELECT job_id,
  array_to_string(skills_extracted, '|') AS skills_extracted,
  CAST(skill_count AS BIGINT) AS skill_count FROM t""")
def skill_tags_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(role_tagged(spark, sf_dir)).select("job_id", "skills_extracted", "skill_count")


@query(f"{checks.ROLE_TAGGED} SELECT job_id, exp_min_years, exp_max_years FROM t")
def experience_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = role_clean(spark, sf_dir)
    found = text.search_text(F.col("title"), F.col("description_clean"))
    return skill_fn.with_experience(df, found).select("job_id", "exp_min_years", "exp_max_years")


PAGE_PREFIXES = f"WITH rows_ AS ({inputs.PAGE_SQL}), prefixes AS ({checks.prefixes_sql('rows_')})"
ROLE_PREFIXES = f"WITH {checks.ROLE_CLEAN}, prefixes AS ({checks.prefixes_sql('cleaned')})"


@query(f"{PAGE_PREFIXES} SELECT company, n AS rows, prefix FROM prefixes")
def company_prefix_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.company_prefixes(inputs.page_postings(spark, sf_dir))


@query(f"{ROLE_PREFIXES} SELECT company, n AS rows, prefix FROM prefixes")
def company_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.company_prefixes(role_clean(spark, sf_dir))


@query(f"{ROLE_PREFIXES} SELECT company, n AS rows, left(prefix, 80) AS sample FROM prefixes")
def company_prefix_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.prefix_log(prefix.company_prefixes(role_clean(spark, sf_dir)))


@query(f"""{PAGE_PREFIXES} SELECT page_id, CASE WHEN prefix IS NULL THEN description_clean
  ELSE trim(substr(description_clean, length(prefix) + 1)) END AS description_clean
  FROM rows_ LEFT JOIN prefixes USING (company)""")
def prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.page_postings(spark, sf_dir)
    return prefix.strip_prefixes(pages, prefix.company_prefixes(pages)) \
        .select("page_id", "description_clean")


@query(f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company, title
  ORDER BY length(description_clean) DESC, posting_id) AS rn FROM ({inputs.DOCUMENT_SQL}))
  WHERE rn = 1""")
def dedupe_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_longest(inputs.document_postings(spark, sf_dir), ties=("posting_id",))


@query(f"""SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT company, title
  FROM ({inputs.DOCUMENT_SQL}))) AS rows_after FROM documents""")
def dedupe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_counts(inputs.document_postings(spark, sf_dir))


@query(f"{checks.ROLE_TABLE} SELECT {FLAT_SQL} FROM t")
def clean_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(clean_plan(inputs.role_postings(spark, sf_dir)))

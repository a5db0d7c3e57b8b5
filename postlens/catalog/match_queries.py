"""Résumé matching, listings, prompts and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.catalog import checks, inputs
from postlens.catalog.registry import query
from postlens.catalog.text_queries import document_tagged, flat, role_tagged
from postlens.functions.labels import match_label
from postlens.operators import match, reports, roles
from postlens.plans.matching import gap_prompts, resume_skills
from postlens.session import new_folder, spread_small, stage
from postlens.sources import resumes as resume_source

DOCS, ROLES = checks.DOCUMENT_TAGGED, checks.ROLE_TAGGED
WANTED = ["from", "nicht", "that", "the", "thanedble", "token", "was", "which"]
WANTED_SQL = "[" + ", ".join(f"'{s}'" for s in WANTED) + "]"


def scores_sql(wanted: str) -> str:
    """Score columns for `skills_extracted` against the list `wanted`."""
    shared = f"list_intersect(skills_extracted, {wanted})"
    return f"""len({shared})::INTEGER AS matched_count, skill_count::INTEGER AS job_requires,
  (CASE WHEN skill_count > 0 THEN round_even(len({shared}) / skill_count * 100, 0) ELSE 0 END)
  ::INTEGER AS coverage_pct, CASE WHEN len({shared}) = 0 THEN '-'
  ELSE array_to_string(list_sort({shared}), ', ') END AS matched_skills"""


@query(f"""WITH {checks.RESUME_TAGGED} SELECT resume_id,
  array_to_string(skills_extracted, '|') AS skills_extracted,
  CAST(len(skills_extracted) AS BIGINT) AS skill_count FROM r""")
def resume_skill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resume_skills(inputs.resumes(spark, sf_dir), inputs.PROSE_TERMS)
    return flat(found).select("resume_id", "skills_extracted", "skill_count")


@query(f"""SELECT resume_id FROM ({inputs.RESUME_SQL})
  WHERE length(regexp_replace(text, '^{checks.SPACE}+|{checks.SPACE}+$', '', 'g')) >= 100""")
def usable_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume_source.usable(inputs.resumes(spark, sf_dir)).select("resume_id")


@query(f"""SELECT * FROM (SELECT resume_id,
  length(regexp_replace(text, '^{checks.SPACE}+|{checks.SPACE}+$', '', 'g'))::INTEGER AS chars
  FROM ({inputs.RESUME_SQL})) WHERE chars < 100""")
def rejected_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume_source.too_short(inputs.resumes(spark, sf_dir))


def _write_files(it: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A file for each résumé, many with bytes that are no UTF-8."""
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    for batch in it:
        for key, text in zip(batch["resume_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = text.encode()
            if key % 3 == 0:
                data = b"\xff" + data + "é".encode()[:1]
            elif key % 3 == 1:
                data = data.replace(b" ", b" \xe2\x82", 2).replace(b"e", b"\xfee", 1)
            with store.open_output_stream(f"{path}/{key}.txt") as out:
                out.write(data)
        yield batch.select(["resume_id"])


@query(f"""SELECT resume_id::VARCHAR AS resume_id, md5(text) AS text_md5,
  length(regexp_replace(text, '^{checks.SPACE}+|{checks.SPACE}+$', '', 'g')) >= 100 AS usable
  FROM ({inputs.RESUME_SQL})""")
def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumés as files with broken bytes, read back. Each file is listed and opened once: what is read is
    staged for the three passes over it."""
    folder = new_folder(spark, "resume-files")
    spread_small(inputs.resumes(spark, sf_dir).filter(F.col("text").isNotNull()), "resume_id") \
        .mapInArrow(lambda it: _write_files(it, folder), "resume_id long").count()
    found = stage(resume_source.read_resumes(spark, folder), "resume-texts")
    fit = resume_source.usable(found).select("resume_id", F.lit(True).alias("usable"))
    short = resume_source.too_short(found).select("resume_id", F.lit(False).alias("usable"))
    return found.select("resume_id", F.md5("text").alias("text_md5")) \
        .join(fit.unionByName(short), "resume_id")


SCORE_COLUMNS = ["matched_count", "job_requires", "coverage_pct", "matched_skills"]


@query(f"{DOCS} SELECT posting_id, {scores_sql(WANTED_SQL)} FROM t")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.score_postings(document_tagged(spark, sf_dir), WANTED) \
        .select("posting_id", *SCORE_COLUMNS)


@query(f"""{DOCS} SELECT posting_id, * EXCLUDE (posting_id, title, company),
  title || ' @ ' || company || ' -- ' || matched_count || ' skills matched' AS label
  FROM (SELECT posting_id, title, company, {scores_sql(WANTED_SQL)} FROM t)
  ORDER BY matched_count DESC, coverage_pct DESC, posting_id LIMIT 25""")
def match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = match.score_postings(document_tagged(spark, sf_dir), WANTED)
    label = match_label(F.col("title"), F.col("company"), F.col("matched_count"))
    return match.best_matches(scored, ["posting_id"]) \
        .select("posting_id", *SCORE_COLUMNS, label.alias("label"))


MATCHED = f"""{DOCS}, {checks.RESUME_TAGGED},
scored AS (SELECT resume_id, posting_id, {scores_sql("wanted")}
  FROM t CROSS JOIN (SELECT resume_id, skills_extracted AS wanted FROM r)),
matches AS (SELECT * FROM (SELECT resume_id, row_number() OVER (PARTITION BY resume_id
  ORDER BY matched_count DESC, coverage_pct DESC, posting_id)::INTEGER AS place,
  * EXCLUDE (resume_id) FROM scored) WHERE place <= 25)"""


@query(f"{MATCHED} SELECT * FROM matches")
def match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resume_skills(inputs.resumes(spark, sf_dir), inputs.PROSE_TERMS)
    return match.match_many(found, document_tagged(spark, sf_dir))


def prompt_sql() -> str:
    skills = "CASE WHEN len(skills_extracted) > 0 THEN array_to_string(skills_extracted, ', ') " \
        "ELSE 'none reliably extracted' END"
    places = {"month": "'July 2026'", "resume": "x.text", "title": "title", "company": "company",
              "location": "coalesce(location, 'None')", "skills": skills,
              "description": "description_clean"}
    sql = "'" + reports.PROMPT.replace("'", "''") + "'"
    for name, value in places.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


@query(f"""{MATCHED} SELECT m.resume_id, m.place, m.posting_id, md5({prompt_sql()}) AS prompt_md5
  FROM matches m JOIN ({inputs.RESUME_SQL}) x USING (resume_id) JOIN t USING (posting_id)
  WHERE length(regexp_replace(x.text, '^{checks.SPACE}+|{checks.SPACE}+$', '', 'g')) >= 100""")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = gap_prompts(inputs.resumes(spark, sf_dir), document_tagged(spark, sf_dir),
                          F.lit("2026-07-11").cast("date"), inputs.PROSE_TERMS)
    return prompts.select("resume_id", "place", "posting_id", F.md5("prompt").alias("prompt_md5"))


CHOSEN = 17


@query(f"""{DOCS}, {checks.RESUME_TAGGED}, p AS (SELECT * FROM t ORDER BY posting_id LIMIT 1 OFFSET {CHOSEN})
SELECT x.resume_id, md5({prompt_sql()}) AS prompt_md5 FROM p, ({inputs.RESUME_SQL}) x
WHERE length(regexp_replace(x.text, '^{checks.SPACE}+|{checks.SPACE}+$', '', 'g')) >= 100""")
def prompt_one_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts for one posting, picked by its position."""
    posting = reports.posting_at(document_tagged(spark, sf_dir), CHOSEN, ["posting_id"])
    fit = resume_source.usable(inputs.resumes(spark, sf_dir))
    prompts = reports.prompts_for(posting, fit, F.lit("2026-07-11").cast("date"))
    return prompts.select("resume_id", F.md5("prompt").alias("prompt_md5"))


GENERATED = "2026-07-11 09:05:07"


@query(f"""{ROLES} SELECT 'gap_analysis_' || left(regexp_replace(title, '[^\\pL\\pN]', '_', 'g'), 40)
  || '_20260711_090507.md' AS path, '# Gap Analysis: ' || title || ' @ ' ||
  coalesce(company, 'None') || chr(10) || chr(10) || '**Generated:** 2026-07-11 09:05' || chr(10)
  || '**Resume used:** me.txt' || chr(10) || '**Job location:** ' || coalesce(location, 'None') ||
  chr(10) || '**Job posting URL:** ' || coalesce(url, 'n/a') || chr(10) || chr(10) || '---' ||
  chr(10) || chr(10) || skill_count || ' skills named.' || chr(10) AS content FROM t""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role_tagged(spark, sf_dir).select(
        "title", "company", "location", "url",
        F.concat(F.col("skill_count").cast("string"), F.lit(" skills named.")).alias("analysis"),
        F.lit("me.txt").alias("resume_name"),
        F.lit(GENERATED).cast("timestamp").alias("generated_at"))
    return reports.report_documents(rows)


@query(f"""{ROLES}, first AS (SELECT *, length(title) AS cluster,
    row_number() OVER (ORDER BY title, company, job_id) - 1 AS i FROM t
  ORDER BY title, company, job_id LIMIT 30)
SELECT CAST(i AS INTEGER) AS index, '[' || i || '] ' || title || ' @ ' || coalesce(company, 'None')
  || ' (cluster ' || cluster || ') -- ' || array_to_string(skills_extracted[1:4], ', ') AS line
  FROM first""")
def posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role_tagged(spark, sf_dir).withColumn("cluster", F.length("title"))
    order = ["title", F.col("company").asc_nulls_last(), "job_id"]
    return reports.posting_list(rows, order)


@query(f"""{ROLES} SELECT title, company, location, array_to_string(skills_extracted, ', ')
  AS skills_extracted FROM t WHERE length(title) = 15 ORDER BY title, job_id LIMIT 15""")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role_tagged(spark, sf_dir).withColumn("cluster", F.length("title"))
    return roles.cluster_members(rows, 15, ["title", "job_id"])


@query(f"""{ROLES} SELECT job_id, title, company FROM t WHERE title = 'ECONOMY hot gear'
  AND company = 'Brand#3' ORDER BY job_id LIMIT 1""")
def find_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.find_posting(role_tagged(spark, sf_dir), "ECONOMY hot gear", "Brand#3",
                                 ["job_id"])
    return found.select("job_id", "title", "company")


@query(f"""{ROLES} SELECT job_id, title FROM t ORDER BY title, job_id LIMIT 1 OFFSET 42""")
def posting_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.posting_at(role_tagged(spark, sf_dir), 42, ["title", "job_id"]) \
        .select("job_id", "title")

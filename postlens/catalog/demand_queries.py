"""Demand aggregates and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.catalog import checks, inputs
from postlens.catalog.registry import query
from postlens.catalog.text_queries import document_tagged, role_clean, role_tagged
from postlens.operators import demand
from postlens.plans.dashboard import overview
from postlens.streaming.trend import skill_trend
from postlens.taxonomy import ROLE_PAIRS, ROLE_SKILLS, category_table

ROLES, DOCS = checks.ROLE_TAGGED, checks.DOCUMENT_TAGGED
COUNTS = "counts AS (SELECT skill, count(*) AS postings FROM " \
    "(SELECT unnest(skills_extracted) AS skill FROM t) GROUP BY skill)"
PCT = "round_even(postings / (SELECT count(*) FROM t) * 100, 1)"


@query(f"{DOCS}, {COUNTS} SELECT * FROM counts")
def skill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.ranked_skills(document_tagged(spark, sf_dir))


@query(f"{ROLES}, {COUNTS} SELECT * FROM counts")
def skill_counts_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.ranked_skills(role_tagged(spark, sf_dir))


@query(f"""{DOCS}, {COUNTS} SELECT skill, postings, CAST({PCT} AS DOUBLE) AS pct,
  postings || ' (' || CAST({PCT} AS DOUBLE) || '%)' AS label
  FROM counts ORDER BY postings DESC, skill LIMIT 20""")
def top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.top_skills(document_tagged(spark, sf_dir), 20)


@query(f"""{ROLES}, {COUNTS} SELECT coalesce(category, 'Other') AS category,
  CAST(sum(postings) AS BIGINT) AS mentions FROM counts
  LEFT JOIN {checks.categories_sql(ROLE_SKILLS)} USING (skill) GROUP BY ALL""")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.category_totals(role_tagged(spark, sf_dir), category_table(spark))


@query("SELECT source, count(*) AS postings FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.source_counts(inputs.table(spark, sf_dir, "documents"))


@query(f"""{ROLES} SELECT exp_min_years AS years, count(*) AS postings,
  (SELECT count(exp_min_years) FROM t) AS parsed, (SELECT count(*) FROM t) AS total
  FROM t WHERE exp_min_years IS NOT NULL GROUP BY exp_min_years""")
def experience_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.experience_histogram(role_tagged(spark, sf_dir))


PAIRS = [pair for pairs in ROLE_PAIRS.values() for pair in pairs] + [("AWS", "Cobol")]
PAIR_ROWS = ", ".join(f"({2 * i + j}, '{'ab'[j]}', '{s}')"
                      for i, p in enumerate(PAIRS) for j, s in enumerate(p))


@query(f"""{ROLES}, {COUNTS} SELECT pos, side, p.skill, coalesce(postings, 0) AS postings
  FROM (VALUES {PAIR_ROWS}) AS p(pos, side, skill) LEFT JOIN counts c ON p.skill = c.skill""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.head_to_head(role_tagged(spark, sf_dir), PAIRS)


COOC = f"""{DOCS}, {COUNTS},
top AS (SELECT skill, CAST(row_number() OVER (ORDER BY postings DESC, skill) - 1 AS INTEGER) AS place
  FROM counts ORDER BY place LIMIT 15),
have AS (SELECT posting_id, skill FROM (SELECT posting_id, unnest(skills_extracted) AS skill FROM t)),
pairs AS (SELECT x.skill AS a, y.skill AS b, count(*) AS n FROM have x JOIN have y
  USING (posting_id) GROUP BY ALL),
cells AS (SELECT x.place AS rank_a, y.place AS rank_b, x.skill AS a, y.skill AS b,
  coalesce(n, 0) AS postings FROM top x CROSS JOIN top y
  LEFT JOIN pairs p ON p.a = x.skill AND p.b = y.skill)"""


@query(f"{COOC} SELECT * FROM cells")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.cooccurrence(document_tagged(spark, sf_dir), 15)


BY_PLACE = ", ".join(f"CAST(sum(postings) FILTER (rank_b = {i}) AS BIGINT) AS place_{i:02}"
                     for i in range(15))


@query(f"{COOC} SELECT a, {BY_PLACE} FROM cells GROUP BY a")
def cooccurrence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills' columns are renamed by place, so that they are the same for any input."""
    cells = demand.cooccurrence(document_tagged(spark, sf_dir), 15)
    names = [r["b"] for r in cells.where("rank_a = 0").orderBy("rank_b").select("b").collect()]
    matrix = demand.cooccurrence_matrix(cells, names)
    return matrix.select("a", *((F.col(f"`{names[i]}`") if i < len(names) else F.lit(None))
                                .cast("bigint").alias(f"place_{i:02}") for i in range(15)))


@query(f"""{ROLES}, {COUNTS},
leaves AS (SELECT coalesce(category, 'Other') AS category, skill, postings FROM counts
  LEFT JOIN {checks.categories_sql(ROLE_SKILLS)} USING (skill))
SELECT category, skill, false AS is_parent, postings, CAST(postings AS DOUBLE) AS color FROM leaves
UNION ALL SELECT category, NULL, true, CAST(sum(postings) AS BIGINT),
  sum(postings * postings) / sum(postings) FROM leaves GROUP BY category""")
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.hierarchy(role_tagged(spark, sf_dir), category_table(spark))


@query(f"""{ROLES} SELECT count(*) AS postings, count(DISTINCT company) AS companies,
  CAST(round_even(avg(skill_count), 1) AS DOUBLE) AS mean_skills FROM t""")
def headline_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.headline_numbers(role_tagged(spark, sf_dir))


@query(f"""{ROLES} SELECT count(*) AS postings, count_if(skill_count = 0)::BIGINT AS zero_skill,
  round_even(avg((skill_count = 0)::INT) * 100, 1)::DOUBLE AS zero_skill_pct,
  count_if(exp_min_years IS NOT NULL)::BIGINT AS with_band,
  round_even(avg((exp_min_years IS NOT NULL)::INT) * 100, 1)::DOUBLE AS with_band_pct,
  round_even(avg(skill_count), 1)::DOUBLE AS mean_skills FROM t""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.run_summary(role_tagged(spark, sf_dir))


@query(f"""{ROLES} SELECT description_is_truncated, count(*) AS postings FROM t
  WHERE list_contains(skills_extracted, 'Python') AND NOT list_contains(skills_extracted, 'SQL')
  GROUP BY ALL""")
def truncation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.truncation_audit(role_tagged(spark, sf_dir), "Python", "SQL")


#: Hits by splitting at the words in lower case, so that no hit takes text from the next one.
SPANS = """p AS (SELECT lower(description_clean) AS d, string_split(replace(lower(description_clean),
    'excel', 'scala'), 'scala') AS s FROM cleaned),
  h AS (SELECT d, length(array_to_string(s[1:i], '.....')) AS b
    FROM p, unnest(range(1, len(s))) AS t(i)),
  l AS (SELECT d[greatest(1, b - 29):b] AS x, d[b + 1:b + 5] AS w, d[b + 6:b + 35] AS y FROM h)"""


@query(f"""WITH {checks.ROLE_CLEAN}, {SPANS} SELECT string_split(x, chr(10))[-1] || w
  || string_split(y, chr(10))[1] AS span, count(*) AS hits FROM l GROUP BY ALL""")
def span_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.span_audit(role_clean(spark, sf_dir), "description_clean", ["scala", "excel"])


@query(f"""WITH {checks.ROLE_CLEAN}, {checks.spans_sql("cleaned", "description_clean", ROLE_SKILLS)}
SELECT skill, span, count(*) AS hits FROM x GROUP BY ALL""")
def skill_span_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of all skills of the taxonomy."""
    return demand.skill_span_audit(role_clean(spark, sf_dir), "description_clean")


@query(f"""WITH raw AS ({inputs.ROLE_SQL})
SELECT 'source' AS level, source, count(*) AS postings FROM raw GROUP BY source
UNION ALL SELECT 'all', NULL, count(*) FROM raw
UNION ALL SELECT 'merged', NULL, count(*) FROM (SELECT DISTINCT company, title FROM raw)""")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.merge_counts(inputs.role_postings(spark, sf_dir))


LISTED = ", ".join(f"('{title}', {2 * i + j}, '{skill}')" for title, listed in ROLE_PAIRS.items()
                   for i, pair in enumerate(listed) for j, skill in enumerate(pair))


@query(f"""{ROLES}, {COUNTS},
best AS (SELECT skill, postings, row_number() OVER (ORDER BY postings DESC, skill) AS place FROM counts),
cats AS (SELECT coalesce(category, 'Other') AS category, skill, postings FROM counts
  LEFT JOIN {checks.categories_sql(ROLE_SKILLS)} USING (skill)),
have AS (SELECT job_id, unnest(skills_extracted) AS skill FROM t)
SELECT 'headline' AS part, 'postings' AS item, count(*)::DOUBLE AS value FROM t
UNION ALL SELECT 'headline', 'companies', count(DISTINCT company) FROM t
UNION ALL SELECT 'headline', 'mean_skills', round_even(avg(skill_count), 1) FROM t
UNION ALL SELECT 'run_summary', 'zero_skill', count_if(skill_count = 0) FROM t
UNION ALL SELECT 'run_summary', 'with_band', count_if(exp_min_years IS NOT NULL) FROM t
UNION ALL SELECT 'top_skills', skill, postings FROM best WHERE place <= 20
UNION ALL SELECT 'categories', category, sum(postings) FROM cats GROUP BY category
UNION ALL SELECT 'sources', source, count(*) FROM t WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'experience', exp_min_years::VARCHAR, count(*) FROM t WHERE exp_min_years IS NOT NULL
  GROUP BY exp_min_years
UNION ALL SELECT 'cooccurrence', x.skill || ' + ' || y.skill, coalesce(n, 0) FROM best x JOIN best y
  ON x.place <= 15 AND y.place <= 15 LEFT JOIN (SELECT p.skill AS a, q.skill AS b, count(*) AS n
  FROM have p JOIN have q USING (job_id) GROUP BY ALL) ON a = x.skill AND b = y.skill
UNION ALL SELECT 'hierarchy', category || '/' || skill, postings FROM cats
UNION ALL SELECT 'hierarchy', category, sum(postings) FROM cats GROUP BY category
UNION ALL SELECT title, pos || ' ' || p.skill, coalesce(postings, 0) FROM (VALUES {LISTED})
  AS p(title, pos, skill) LEFT JOIN counts USING (skill)""")
def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of the overview as one, a number per row."""
    tables = overview(role_tagged(spark, sf_dir))

    def rows(part: str, item: Column, value: str, df: DataFrame | None = None) -> DataFrame:
        return (tables[part] if df is None else df).select(
            F.lit(part).alias("part"), item.alias("item"), F.col(value).cast("double").alias("value"))

    skill, place = F.col("skill"), F.col("pos").cast("string")
    parts = [rows(part, F.lit(c), c) for part, columns in {
        "headline": ["postings", "companies", "mean_skills"], "run_summary": ["zero_skill", "with_band"],
    }.items() for c in columns]
    parts += [
        rows("top_skills", skill, "postings"), rows("categories", F.col("category"), "mentions"),
        rows("sources", F.col("source"), "postings"),
        rows("experience", F.col("years").cast("string"), "postings"),
        rows("cooccurrence", F.concat("a", F.lit(" + "), "b"), "postings"),
        rows("hierarchy", F.concat_ws("/", "category", "skill"), "postings"),
    ]
    parts += [rows(title, F.concat(place, F.lit(" "), skill), "postings") for title in ROLE_PAIRS]
    return reduce(DataFrame.unionByName, parts)


TREND = """WITH t AS (SELECT date_trunc('{period}', {ts})::TIMESTAMP AS period, {labels} AS skills
  FROM {table}),
totals AS (SELECT period, count(*) AS total FROM t GROUP BY period),
counts AS (SELECT period, skill, count(*) AS postings FROM
  (SELECT period, unnest(skills) AS skill FROM t) GROUP BY ALL),
ranked AS (SELECT period, skill, postings,
  round_even(postings / total * 100, 1)::DOUBLE AS pct,
  row_number() OVER (PARTITION BY period ORDER BY postings DESC, skill)::INTEGER AS place
  FROM counts JOIN totals USING (period))
SELECT *, lag(place) OVER (PARTITION BY skill ORDER BY period) - place AS place_change FROM ranked"""


@query(TREND.format(period="month", ts="o_orderdate", table="orders",
                    labels="[o_orderpriority, o_orderstatus]"))
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("scraped_at"),
        F.array("o_orderpriority", "o_orderstatus").alias("skills_extracted"))
    return skill_trend(orders)


@query(TREND.format(period="week", ts="ts", table="events", labels="[event_type]"))
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events").select(
        F.col("ts").alias("scraped_at"), F.array("event_type").alias("skills_extracted"))
    return skill_trend(events, period="week")


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.distinct_values(inputs.table(spark, sf_dir, "documents"), "source")

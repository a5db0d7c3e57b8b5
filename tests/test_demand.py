import pytest
from pyspark.sql import functions as F

from postlens.operators import demand
from postlens.plans.dashboard import overview
from postlens.taxonomy import ROLE_PAIRS, category_table

# Figures published for one real run: skill -> postings, of 407.
PUBLISHED = {"Machine Learning": (173, 42.5), "Generative AI": (98, 24.1), "LLM": (96, 23.6),
             "Python": (87, 21.4), "Agents": (72, 17.7), "RAG": (56, 13.8), "NLP": (46, 11.3),
             "Azure": (44, 10.8), "AWS": (38, 9.3), "Prompt Engineering": (33, 8.1)}


@pytest.fixture(scope="module")
def postings(spark):
    """407 postings on which each published skill occurs as often as published."""
    rows = []
    for i in range(407):
        found = sorted(s for s, (n, _) in PUBLISHED.items() if i < n)
        rows.append((f"s{i % 3}" if i % 10 else None, f"c{i % 50}" if i % 7 else None, found,
                     len(found), i % 4 if i < 57 else None, i % 2 == 0))
    return spark.createDataFrame(
        rows, "source string, company string, skills_extracted array<string>, skill_count int, "
        "exp_min_years int, description_is_truncated boolean")


def test_top_skills_match_published_shares(postings):
    got = demand.top_skills(postings, 10).collect()
    assert [(r["skill"], r["postings"], r["pct"]) for r in got] == \
        [(s, n, p) for s, (n, p) in PUBLISHED.items()]
    assert got[0]["label"] == "173 (42.5%)"


def test_hierarchy_colour_is_count_weighted(spark):
    df = spark.createDataFrame([(["Tableau", "Power BI", "Excel"],)] * 3 + [(["Tableau"],)],
                               "skills_extracted array<string>")
    rows = {(r["category"], r["skill"]): r for r in
            demand.hierarchy(df, category_table(spark)).collect()}
    top = rows[("BI / Visualization", None)]
    assert (top["postings"], round(top["color"], 6), top["is_parent"]) == (10, 3.4, True)
    assert rows[("BI / Visualization", "Tableau")]["color"] == 4.0


def test_unknown_skill_is_other(spark):
    df = spark.createDataFrame([(["Cobol"],)], "skills_extracted array<string>")
    assert demand.category_totals(df, category_table(spark)).collect()[0]["category"] == "Other"


def test_head_to_head_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(["AWS"],), (["AWS", "Azure"],), ([],)],
                               "skills_extracted array<string>")
    got = demand.head_to_head(df, [("AWS", "Azure"), ("Azure", "GCP")]).collect()
    assert [(r["skill"], r["postings"]) for r in got] == \
        [("AWS", 2), ("Azure", 1), ("Azure", 1), ("GCP", 0)]


def test_experience_histogram(postings):
    got = demand.experience_histogram(postings).collect()
    assert [r["years"] for r in got] == [0, 1, 2, 3]
    assert sum(r["postings"] for r in got) == 57
    assert {(r["parsed"], r["total"]) for r in got} == {(57, 407)}


def test_cooccurrence_is_symmetric_with_counts_on_the_diagonal(postings):
    cells = {(r["a"], r["b"]): r["postings"] for r in demand.cooccurrence(postings, 5).collect()}
    top = list(PUBLISHED)[:5]
    assert set(cells) == {(a, b) for a in top for b in top}
    for a in top:
        for b in top:
            assert cells[a, b] == cells[b, a] == min(PUBLISHED[a][0], PUBLISHED[b][0])


def test_cooccurrence_zeros(spark):
    df = spark.createDataFrame([(["a"],), (["b"],)], "skills_extracted array<string>")
    cells = demand.cooccurrence(df, 15)
    assert [(r["a"], r["b"], r["postings"]) for r in cells.collect()] == \
        [("a", "a", 1), ("a", "b", 0), ("b", "a", 0), ("b", "b", 1)]


def test_summaries(postings):
    n = postings.count()
    head = demand.headline_numbers(postings).collect()[0]
    assert (head["postings"], head["companies"]) == (n, 50)
    run = demand.run_summary(postings).collect()[0]
    assert (run["with_band"], run["with_band_pct"]) == (57, 14.0)
    assert run["zero_skill"] == n - 173
    assert sum(r["postings"] for r in demand.source_counts(postings).collect()) == \
        postings.filter("source is not null").count()
    audit = demand.truncation_audit(postings, "Machine Learning", "Python").collect()
    assert sum(r["postings"] for r in audit) == 173 - 87


def test_tagging_is_not_repeated_under_the_aggregate(spark):
    from postlens.functions.skills import with_skills

    df = with_skills(spark.createDataFrame([("python",)], "x string"), F.col("x"))
    plan = demand.skill_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_folded") <= 200 and "Filter (size" not in plan


def test_overview_has_every_table(postings):
    tables = overview(postings)
    assert set(ROLE_PAIRS) < set(tables)
    assert all(t.columns for t in tables.values())
    assert tables["top_skills"].count() == 10


def test_cooccurrence_matrix_columns(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b"],)], "skills_extracted array<string>")
    rows = demand.cooccurrence_matrix(demand.cooccurrence(df, 15), ["b", "a"]).collect()
    assert [tuple(r[1:]) for r in rows] == [(2, 1), (1, 1)]

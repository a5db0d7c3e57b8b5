import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import match, reports
from postlens.plans.matching import gap_prompts


def brute(resumes, postings, n):
    out = {}
    for rid, want in resumes:
        scored = []
        for pid, held in postings:
            shared = set(want) & set(held)
            need = len(set(held))
            pct = round(len(shared) / need * 100) if need else 0
            scored.append((-len(shared), -pct, pid, need, ", ".join(sorted(shared)) or "-"))
        for place, (m, c, pid, need, names) in enumerate(sorted(scored)[:n], 1):
            out[rid, place] = (pid, -m, need, -c, names)
    return out


def run(spark, resumes, postings, n, **kw):
    kind = "array<string>"
    r = spark.createDataFrame(resumes, f"resume_id long, skills_extracted {kind}")
    p = spark.createDataFrame(postings, f"posting_id long, skills_extracted {kind}")
    rows = match.match_many(r, p, n, **kw).collect()
    got = {(x["resume_id"], x["place"]): (x["posting_id"], x["matched_count"], x["job_requires"],
                                          x["coverage_pct"], x["matched_skills"]) for x in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    """With adaptive execution, and without it, so that small inputs use all shuffle partitions."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("seed, names, size", [(1, 8, 5), (2, 30, 12), (3, 150, 20)])
def test_match_many_equals_scoring_all_pairs(spark, adaptive, seed, names, size):
    rng = random.Random(seed)
    pool = [f"skill {i}" for i in range(names)]
    # every third set holds the hot skill, some sets repeat, some are empty
    def some(i):
        chosen = rng.sample(pool[1:], rng.randint(0, size) if i % 5 else 0)
        return chosen + ([pool[0]] if i % 3 == 0 else [])

    postings = [(i, some(i)) for i in range(200)] + [(1000 + i, pool[:2]) for i in range(40)]
    resumes = [(i, some(i)) for i in range(25)] + [(100, ["never seen"]), (101, []),
                                                   (102, pool[:1]), (103, pool[:1])]
    assert run(spark, resumes, postings, 7) == brute(resumes, postings, 7)


def test_fewer_postings_than_places(spark):
    resumes, postings = [(1, ["a"]), (2, [])], [(1, ["b"]), (2, ["a", "b"]), (3, [])]
    assert run(spark, resumes, postings, 25) == brute(resumes, postings, 25)


def test_no_skill_anywhere(spark):
    resumes, postings = [(1, ["a"])], [(i, []) for i in range(9)]
    assert run(spark, resumes, postings, 4) == brute(resumes, postings, 4)


def test_single_resume_scores(spark):
    df = spark.createDataFrame(
        [(1, list("BCDEFGHI")), (2, []), (3, ["A", "B"])], "id int, skills_extracted array<string>")
    got = match.best_matches(match.score_postings(df, ["A", "B"]), ["id"]).collect()
    assert [(r["id"], r["matched_count"], r["coverage_pct"], r["matched_skills"]) for r in got] == \
        [(3, 2, 100, "A, B"), (1, 1, 12, "B"), (2, 0, 0, "-")]


def test_prompt_and_report(spark):
    postings = spark.createDataFrame(
        [(1, "ML Engineer {title}", None, None, ["LLM"], "Build 100% of it.")],
        "posting_id long, title string, company string, location string, "
        "skills_extracted array<string>, description_clean string")
    text = "I know LLM work. " * 10
    resumes = spark.createDataFrame([("r", text), ("short", "LLM")],
                                    "resume_id string, text string")
    rows = gap_prompts(resumes, postings, F.lit("2026-07-11").cast("date")).collect()
    assert [(r["resume_id"], r["place"]) for r in rows] == [("r", 1)]
    prompt = rows[0]["prompt"]
    assert "actual date is July 2026." in prompt and text in prompt
    assert "Title: ML Engineer {title}\nCompany: None\nLocation: None\n" in prompt
    assert "in posting: LLM\n\nFull description:\nBuild 100% of it.\n" in prompt
    assert prompt == reports.PROMPT.format(
        month="July 2026", resume=text, title="ML Engineer {title}", company="None",
        location="None", skills="LLM", description="Build 100% of it.")

    report = reports.report_documents(postings.withColumns({
        "url": F.lit(None).cast("string"), "analysis": F.lit("Fine."),
        "resume_name": F.lit("me.txt"), "generated_at": F.lit("2026-07-11 09:05:07").cast("timestamp"),
        "title": F.lit("Sr. Ingénieur/ML — 50 characters or more in this title")})).collect()[0]
    assert report["path"] == \
        "gap_analysis_Sr__Ingénieur_ML___50_characters_or_more_20260711_090507.md"
    assert "**Generated:** 2026-07-11 09:05\n" in report["content"]
    assert "URL:** n/a\n\n---\n\nFine.\n" in report["content"]


def test_no_skills_fallback(spark):
    df = spark.createDataFrame([("t", "c", None, [], "d")], "title string, company string, "
                               "location string, skills_extracted array<string>, "
                               "description_clean string")
    prompt = df.select(reports.prompt(F.lit("x"), F.current_date())).collect()[0][0]
    assert "posting: none reliably extracted\n" in prompt


def test_listing_and_lookup(spark):
    df = spark.createDataFrame(
        [(2, "b", None, 4, list("vwxyz")), (1, "a", "acme", 3, [])],
        "id int, title string, company string, cluster int, skills_extracted array<string>")
    lines = [r["line"] for r in reports.posting_list(df, ["id"]).orderBy("index").collect()]
    assert lines == ["[0] a @ acme (cluster 3) -- ", "[1] b @ None (cluster 4) -- v, w, x, y"]
    assert reports.find_posting(df, "a", "acme", ["id"]).collect()[0]["id"] == 1


def postings_frame(spark, rows):
    return spark.createDataFrame(rows, "posting_id long, skills_extracted array<string>")


def test_blocks_and_hot_sets(spark, adaptive, monkeypatch):
    """A skill in a third of all sets is dealt over blocks, a résumé set of a third of all over parts."""
    monkeypatch.setattr(match, "BLOCK", 7)
    monkeypatch.setattr(match, "SCOUTS", 5)
    monkeypatch.setattr(match, "HOT", 4)
    monkeypatch.setattr(match, "PARTS", 3)
    rng = random.Random(6)
    pool = [f"s{i}" for i in range(40)]
    postings = [(i, sorted({"s0"} & set(pool[:i % 3])) + rng.sample(pool[1:], rng.randint(1, 9)))
                for i in range(150)]
    resumes = [(i, pool[:4] if i % 3 == 0 else rng.sample(pool, rng.randint(0, 8))) for i in range(60)]
    assert run(spark, resumes, postings, 6) == brute(resumes, postings, 6)


def test_pairs_looked_at(spark):
    """Every match is among the pairs looked at, and these are far fewer than all pairs."""
    rng = random.Random(8)
    pool = [f"s{i:02d}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    some = [sorted(set(rng.choices(pool, weights, k=rng.randint(1, 9)))) for _ in range(800)]
    r = spark.createDataFrame(list(enumerate(some[:200])), "resume_id long, skills_extracted array<string>")
    m = match.Matching(r, postings_frame(spark, list(enumerate(some[200:]))), 5)
    pairs = m.meetings().agg(F.sum("pairs")).first()[0]
    sets = m.bounded.count() * m.sets.count()
    assert m._met().count() <= pairs < sets / 4


def test_text_moves_once(spark):
    """Résumé texts are in one exchange of the prompt plan, and the postings are tagged in none."""
    text = "I know LLM work. " * 10
    resumes = spark.createDataFrame([(f"r{i}", text + str(i)) for i in range(9)], "resume_id string, text string")
    tagged = F.udf(lambda t: [t], "array<string>")(F.col("title"))
    postings = spark.range(30).select(
        F.col("id").alias("posting_id"), F.lit("LLM").alias("title"), F.lit("c").alias("company"),
        F.lit(None).cast("string").alias("location"), F.repeat(F.lit("d"), 50).alias("description_clean")) \
        .withColumn("skills_extracted", tagged)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        df = gap_prompts(resumes, postings, F.lit("2026-07-11").cast("date"))
        moved, tagging = [], []

        def walk(node):
            if node.nodeName() == "Exchange":
                moved.append(node.output().mkString(" "))
            tagging.append("Python" in node.nodeName())
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

        walk(df._jdf.queryExecution().executedPlan())
        assert sum("text#" in m for m in moved) == 1 and not any(tagging)
        assert df.count() == 9 * 25
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_position_without_sorting_all(spark, monkeypatch):
    """A position near the top is found by each task's first rows, a later one by ranges; both alike."""
    rows = spark.createDataFrame([(f"j{i % 97}", i) for i in range(300)], "title string, n long")
    order = [F.col("title").asc_nulls_last(), "n"]
    near = reports.posting_at(rows, 250, order)
    assert "TakeOrderedAndProject" in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(reports, "FIRST", 0)
    assert near.collect() == reports.posting_at(rows, 250, order).collect()
    assert reports.posting_at(rows, 300, order).collect() == []


def test_resume_files_are_opened_once(spark, tmp_path):
    """What is read of the files is staged, so that no later pass opens them again."""
    from postlens.catalog import match_queries

    text = "experienced worker " * 8
    spark.createDataFrame([(1, 1, text), (2, 1, "short"), (3, 1, None)], "conv_id long, turn int, text string") \
        .coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = match_queries.resume_files(spark, str(tmp_path))
    assert not any(f.endswith(".txt") for f in out.inputFiles())
    assert sorted((r["resume_id"], r["usable"]) for r in out.collect()) == [("1001", True), ("2001", False)]

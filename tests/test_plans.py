import json

from pyspark.sql import functions as F

from postlens import schemas
from postlens.plans.wrangle import clean_postings, longest_first, tag, to_clean
from postlens.sources.landing import read_landing
from postlens.streaming import ingest, trend

INTRO = "Acme has been making parts for every workshop in the region for a very long time now. "


def raw(spark, *rows):
    df = spark.createDataFrame(
        [(c, t, d, j) for c, t, d, j in rows],
        "company string, title string, description_snippet string, job_id string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schemas.RAW])


def test_clean_table(spark):
    rows = raw(
        spark,
        ("acme", "ML engineer", f"<p>{INTRO}</p> Python &amp; SQL, 3-5 years", "1"),
        ("acme", "Analyst", f"<p>{INTRO}</p> Excel", "2"),
        ("acme", "Analyst", f"<p>{INTRO}</p> Excel and Tableau", "3"),
        (None, None, None, "4"))
    df = clean_postings(rows)
    assert {f.name: f.dataType for f in df.schema} == {f.name: f.dataType for f in schemas.CLEAN}
    got = {r["job_id"]: r for r in df.collect()}
    assert set(got) == {"1", "3", "4"}
    assert got["1"]["description_clean"] == "Python & SQL, 3-5 years"
    assert got["1"]["skills_extracted"] == ["Machine Learning", "Python", "SQL"]
    assert (got["1"]["exp_min_years"], got["1"]["exp_max_years"]) == (3, 5)
    assert got["3"]["skills_extracted"] == ["Excel", "Tableau"]
    assert (got["4"]["title"], got["4"]["description_clean"]) == ("", "")
    assert [r["job_id"] for r in df.orderBy(*longest_first(df)).collect()] == ["1", "3", "4"]


def test_repeats_lose_their_text_unless_merged_first(spark):
    rows = raw(spark, ("acme", "a", INTRO + "Python", "1"), ("acme", "a", INTRO + "Python", "2"))
    assert clean_postings(rows).first()["description_clean"] == "Python"
    kept = clean_postings(rows, dedupe_first=True).first()["description_clean"]
    assert kept == INTRO + "Python"


def test_stream_over_two_arrivals_equals_batch(spark, tmp_path):
    land, log, state = (str(tmp_path / n) for n in ("land", "log", "state"))
    (tmp_path / "land").mkdir()

    def arrive(name, rows):
        (tmp_path / "land" / name).write_text(json.dumps(
            [dict(zip(("company", "title", "description_snippet", "job_id"), r)) for r in rows]))
        ingest.ingest(ingest.read_landing_stream(spark, land), log, state).awaitTermination()

    arrive("a.json", [("acme", "t", "Python", "1"), ("b", "u", "SQL and more", "2")])
    arrive("b.json", [("acme", "t", "Python and Spark", "3"), ("b", "u", "SQL", "4")])
    got = ingest.current_postings(spark, log).orderBy("job_id").collect()
    assert [r["job_id"] for r in got] == ["2", "3"]
    batch = tag(to_clean(read_landing(spark, land))).orderBy("job_id").collect()
    assert [r for r in batch if r["job_id"] in ("2", "3")] == got
    assert ingest.posting_table(spark, log).vacuum() > 0
    assert ingest.current_postings(spark, log).orderBy("job_id").collect() == got


def test_trend(spark):
    rows = [("2026-07-02", ["A", "B"]), ("2026-07-09", ["A"]), ("2026-08-01", ["B"]),
            ("2026-08-02", ["B", "A"]), ("2026-08-03", ["B"]), (None, ["A"])]
    df = spark.createDataFrame(rows, "d string, skills_extracted array<string>") \
        .withColumn("scraped_at", F.to_timestamp("d"))
    got = {(str(r["period"])[:7], r["skill"]): (r["postings"], r["pct"], r["place"],
           r["place_change"]) for r in trend.skill_trend(df).collect()}
    assert got == {
        ("2026-07", "A"): (2, 100.0, 1, None), ("2026-07", "B"): (1, 50.0, 2, None),
        ("2026-08", "B"): (3, 100.0, 1, 1), ("2026-08", "A"): (1, 33.3, 2, -1)}


def test_staged_tables_can_be_removed(spark, tmp_path):
    from pathlib import Path

    from postlens.session import drop_staged, stage, staging_root

    drop_staged(spark)
    kept = stage(spark.range(5), "kept")
    kept.write.parquet(str(tmp_path / "out"))
    folder = Path(staging_root(spark).removeprefix("file://"))
    assert any(folder.glob("kept-*"))
    assert drop_staged(spark) == 1 and not any(folder.glob("kept-*"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_queries_leave_no_folder(spark):
    """What queries stage, land and stream through is gone once it is dropped."""
    from pathlib import Path

    import pytest

    import __spark_entry__
    from postlens.session import drop_staged, staging_root

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("test tables not present")
    drop_staged(spark)
    root = Path(staging_root(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    for name in ("clean_postings", "collect_quarantine", "stream_trend", "landing_large_array", "resume_files",
                 "prompt_table"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(root.iterdir()) - before
    assert drop_staged(spark) > 5 and set(root.iterdir()) == before

import json

import pytest
from pyspark.sql import functions as F

from postlens import schemas
from postlens.sources import landing, payloads, resumes, tables


def responses(spark, *payload_texts):
    rows = [("q", p, None) for p in payload_texts]
    return spark.createDataFrame(rows, "query string, payload string, scraped_at timestamp")


def test_board_defaults_follow_key_presence(spark):
    items = [
        {"jobId": 7, "jdURL": "a-7", "footerPlaceholderLabel": "", "experienceText": "2 Yrs",
         "placeholders": [{"label": "Pune"}], "location": "x", "footerLabel": None,
         "createdDate": 17},
        {"jobId": "8", "placeholders": None, "location": "x", "footerPlaceholderLabel": "3 Yrs"},
        {"jdURL": None, "location": ["a", "b"]},
        {},
    ]
    got = payloads.normalise_board(responses(spark, json.dumps({"jobDetails": items}))).collect()
    base = payloads.BOARD_LINK
    assert [r["url"] for r in got] == [base + "a-7", base + "8", base + "None", base]
    assert [r["location"] for r in got] == ['[{"label":"Pune"}]', None, '["a","b"]', None]
    assert [r["experience"] for r in got] == ["2 Yrs", "3 Yrs", None, None]
    assert got[0]["job_id"] == "7" and got[0]["posted_date"] == "17"
    assert {r["source"] for r in got} == {"naukri"}


def test_listing_nested_nulls(spark):
    items = [{"id": "1", "company": None, "location": {"display_name": "L"}, "salary_min": 5},
             {"id": 2, "company": {"display_name": "C"}, "category": {}}]
    got = payloads.normalise_listing(responses(spark, json.dumps({"results": items}))).collect()
    assert [(r["job_id"], r["company"], r["location"], r["category"], r["salary_min"])
            for r in got] == [("1", None, "L", None, 5.0), ("2", "C", None, None, None)]


def test_search_missing_levels_and_defaults(spark):
    items = [{"job_publisher": None, "job_city": "", "job_country": "IN",
              "job_required_experience": {"required_experience_in_months": 24}},
             {"job_city": "Pune", "job_required_skills": ["a"], "job_required_experience": None}]
    frame = responses(spark, json.dumps({"data": {"jobs": items}}), "{}", '{"data": {}}',
                      '{"data": {"jobs": []}}')
    got = payloads.normalise_search(frame).collect()
    assert [(r["source"], r["location"], r["experience"], r["skills"]) for r in got] == \
        [(None, "IN", "24", None), ("jsearch", "Pune", None, '["a"]')]


def test_quarantine(spark):
    frame = responses(spark, '{"jobDetails": []}', '{"error": 1, "code": 2}',
                      '{"jobDetails": null}', "{}")
    got = sorted(r["keys"] for r in payloads.bad_payloads(frame, "jobDetails").collect())
    assert got == [[], ["error", "code"], ["jobDetails"]]


def test_landing_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"source": "s", "title": "t", "skills": ["x"], "experience": 12}, {"source": "s"}]))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "note.txt").write_text("not a snapshot")
    rows = landing.read_landing(spark, str(tmp_path))
    assert rows.schema == schemas.RAW and rows.count() == 2
    first = rows.filter("title = 't'").first()
    assert (first["skills"], first["experience"]) == ('["x"]', "12")
    files = {r["file"]: r["postings"] for r in landing.rows_per_file(spark, str(tmp_path)).collect()}
    assert files == {"a.json": 2, "b.json": 0}


def test_missing_or_empty_landing_folder(spark, tmp_path):
    assert landing.read_landing(spark, str(tmp_path / "none")).count() == 0
    assert landing.read_landing(spark, str(tmp_path)).count() == 0


def test_snapshots_append(spark, tmp_path):
    df = spark.createDataFrame([("s",)], "source string")
    out = str(tmp_path / "snap")
    for at in ("2026-07-01 00:00:00", "2026-08-01 00:00:00"):
        landing.write_snapshot(df, out, "board", F.lit(at).cast("timestamp"))
    back = spark.read.json(out)
    assert {(r["collector"], r["snapshot_ts"]) for r in back.collect()} == \
        {("board", "20260701_000000"), ("board", "20260801_000000")}


def clean_rows(spark):
    return spark.createDataFrame(
        [("s", "q", "1", 'He said "a, b"\nnext', None, None, "d", True, None, "u",
          ["A", "B"], 2, 3, None)], schemas.CLEAN)


def test_clean_table_round_trip(spark, tmp_path):
    df, path = clean_rows(spark), str(tmp_path / "t")
    tables.write_json(df, path)
    assert tables.read_clean(spark, path).collect() == df.collect()
    text = "".join(f.read_text() for f in (tmp_path / "t").glob("*.json"))
    assert '"company":null' in text and '"skills_extracted":["A","B"]' in text
    tables.write_csv(df, path + "csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True) \
        .csv(path + "csv").first()
    assert back["skills_extracted"] == "A, B" and back["title"] == 'He said "a, b"\nnext'


def test_missing_table_names_the_job(spark, tmp_path):
    with pytest.raises(tables.StageMissing, match="plans.wrangle"):
        tables.read_clean(spark, str(tmp_path / "none"))
    with pytest.raises(tables.StageMissing, match="plans.clustering"):
        tables.read_clustered(spark, str(tmp_path / "none"))


def test_resumes(spark, tmp_path):
    (tmp_path / "me.txt").write_bytes(b"caf\xc3\xa9 \xff" + b"x" * 100 + b"\nline two")
    (tmp_path / "kept.v2.txt").write_bytes("�".encode() + b" short \n")
    (tmp_path / "skip.pdf").write_bytes(b"%PDF")
    df = resumes.read_resumes(spark, str(tmp_path))
    got = {r["resume_id"]: r["text"] for r in df.collect()}
    assert got == {"me": "café " + "x" * 100 + "\nline two", "kept.v2": "� short \n"}
    assert [r["resume_id"] for r in resumes.usable(df).collect()] == ["me"]
    assert [tuple(r) for r in resumes.too_short(df).collect()] == [("kept.v2", 7)]


def test_union_of_runs(spark):
    a = spark.createDataFrame([("1",)], "job_id string")
    b = spark.createDataFrame([("1", "x")], "job_id string, extra string")
    got = landing.union_runs(("k1", a), ("k2", b)).collect()
    assert sorted((r["query"], r["extra"]) for r in got if r["extra"]) == [("k2", "x")]
    assert len(got) == 2


def test_one_array_file_from_parts(tmp_path):
    """Part files become one file in their order; only pieces are held."""
    import pyarrow as pa
    from postlens.catalog import source_queries

    parts, folder = tmp_path / "parts", tmp_path / "one"
    parts.mkdir()
    for i, text in enumerate(["[\n", "1,\n" * 900_000, "null ]\n"]):
        (parts / f"part-{i:05d}-x.txt").write_text(text)
    (parts / "_SUCCESS").write_text("")
    batch = pa.RecordBatch.from_arrays([pa.array([0])], names=["id"])
    assert [b.num_rows for b in source_queries._join_files(iter([batch]), str(parts), str(folder))] == [1]
    assert (folder / "all.txt").read_text() == "[\n" + "1,\n" * 900_000 + "null ]\n"


def test_short_rows_are_dealt_over_all_cores(spark, tmp_path):
    """One row group of parts, whose postings are long, is no single task's work."""
    from postlens.catalog import inputs

    spark.range(2000).selectExpr(
        "id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type",
        "cast(id % 50 AS int) AS p_size", "1.5D AS p_retailprice") \
        .coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    set_to = spark.conf.get("spark.postlens.spread")
    spark.conf.unset("spark.postlens.spread")
    try:
        rows = inputs.role_postings(spark, str(tmp_path))
        tasks = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(tasks) == 2000
        assert max(tasks) < 500
    finally:
        spark.conf.set("spark.postlens.spread", set_to)

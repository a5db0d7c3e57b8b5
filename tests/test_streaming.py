"""Merged tables and the stream from responses: what a batch rewrites, and what a killed one leaves."""

import json

import pytest
from pyspark.sql import functions as F

from postlens import schemas
from postlens.session import names_in
from postlens.streaming import ingest, table, trend


def counts(spark, *rows):
    return spark.createDataFrame(
        [(p, s, n) for p, s, n in rows], "d string, skill string, postings long") \
        .select(F.to_timestamp("d").alias("period"), "skill", "postings")


def held(t):
    return sorted((str(r["period"])[:10], r["skill"], r["postings"]) for r in t.read().collect())


def test_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    t = trend.trend_table(spark, str(tmp_path), 16)
    assert t.read().count() == 0 and t.merge(counts(spark), 0) == []
    days = [f"2026-{m:02d}-{d:02d}" for m in range(1, 9) for d in range(1, 29)]
    assert t.merge(counts(spark, *((d, "a", 1) for d in days)), 1) == list(range(16))
    before = t.manifest().written_by
    touched = t.merge(counts(spark, ("2026-03-05", "a", 2), ("2026-03-05", "b", 7)), 2)
    assert len(touched) == 1
    after = t.manifest().written_by
    assert {b for b in after if after[b] != before[b]} == set(touched)
    assert names_in(spark, f"{tmp_path}/data/batch=2") == ["_SUCCESS", f"bucket={touched[0]}"]
    assert ("2026-03-05", "a", 3) in held(t) and ("2026-03-05", "b", 7) in held(t)
    assert len(held(t)) == len(days) + 1


def test_batch_counts_once(spark, tmp_path, monkeypatch):
    t = trend.trend_table(spark, str(tmp_path), 4)
    rows = counts(spark, ("2026-01-01", "a", 1), ("2026-02-01", "a", 5))
    t.merge(rows, 0)
    # killed after its files, before its manifest: nothing of it is read
    with monkeypatch.context() as m:
        m.setattr(table, "write_note", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.merge(rows, 1)
    assert held(t) == [("2026-01-01", "a", 1), ("2026-02-01", "a", 5)]
    t.merge(rows, 1)
    assert t.merge(rows, 1) == [] and t.merge(rows, 0) == []
    want = [("2026-01-01", "a", 2), ("2026-02-01", "a", 10)]
    assert held(t) == want
    t.rebucket(9)
    assert held(t) == want and t.manifest().buckets == 9 and t.vacuum() > 0
    assert held(t) == want and t.vacuum() == 0
    t.merge(rows, 2)
    assert held(t) == [("2026-01-01", "a", 3), ("2026-02-01", "a", 15)]


def test_late_rows_count(spark, tmp_path):
    """Several arrivals, the last one years older; each adds to its own window only."""
    land, state = tmp_path / "land", str(tmp_path / "state")
    land.mkdir()
    t = trend.trend_table(spark, str(tmp_path / "trend"), 8)
    seen = []
    for i, days in enumerate((["2026-07-02", "2026-07-03"], ["2026-07-04", "2026-08-20"], ["2019-01-01"])):
        rows = [{"scraped_at": f"{d} 10:00:00", "skills_extracted": ["a", "b"]} for d in days]
        (land / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("scraped_at timestamp, skills_extracted array<string>").json(str(land))
        trend.running_trend(stream, t, state, trend.window_counts).awaitTermination()
        seen.append(t.manifest())
    whole = spark.read.schema("scraped_at timestamp, skills_extracted array<string>").json(str(land))
    assert sorted(t.read().collect()) == sorted(trend.window_counts(whole).collect())
    kept = {b for b, f in seen[2].written_by.items() if f == seen[1].written_by.get(b)}
    assert kept, "the last batch has one window and leaves the others' buckets alone"


BOARD = {"jobDetails": [{"title": "ML engineer", "companyName": "acme", "jobDescription": "<b>Python</b>",
                         "jobId": 7}, None]}
LISTING = {"results": [{"id": "1", "title": "ML engineer", "company": {"display_name": "acme"},
                        "description": "Python and more SQL"}]}
RESPONSES = [
    ("naukri", json.dumps(BOARD)), ("adzuna", json.dumps(LISTING)), ("jsearch", "{}"),
    ("jsearch", '{"data": {"jobs": [{"job_title": "x", "job_publisher": null}]}}'),
    ("adzuna", '{"results": []}'), ("adzuna", '{"error": 1}'), ("naukri", '{"jobDetails": 5}'),
    ("naukri", "not json"), ("naukri", None), ("new one", "{}"), (None, '{"a": 1, "b": 2}'),
    ("jsearch", "[1]"),
]


def responses(spark):
    rows = [(s, f"q{i}", p) for i, (s, p) in enumerate(RESPONSES)]
    return spark.createDataFrame(rows, "service string, query string, payload string") \
        .withColumn("scraped_at", F.to_timestamp(F.lit("2026-07-11 09:05:07")))


def test_responses_sorted_out(spark):
    got = {(r["search_query"], r["title"], r["source"]) for r in ingest.postings_of(responses(spark)).collect()}
    assert got == {("q1", "ML engineer", "adzuna"), ("q3", "x", None)}
    bad = {r["query"]: (r["service"], r["reason"], r["keys"], r["payload"])
           for r in ingest.quarantine_of(responses(spark)).collect()}
    assert bad == {
        "q5": ("adzuna", "no list of postings", ["error"], '{"error": 1}'),
        "q6": ("naukri", "no list of postings", ["jobDetails"], '{"jobDetails": 5}'),
        "q7": ("naukri", "not a JSON object", [], "not json"),
        "q8": ("naukri", "not a JSON object", [], None),
        "q9": ("new one", "unknown service", [], "{}"),
        "q10": (None, "unknown service", ["a", "b"], '{"a": 1, "b": 2}'),
        "q11": ("jsearch", "not a JSON object", [], "[1]")}


@pytest.mark.parametrize("killed_in", ["table", "ingest"])
def test_killed_batch_changes_nothing(spark, tmp_path, monkeypatch, killed_in):
    """A batch fails after its log, before the merge is visible or before it is closed. Run again from
    the same checkpoint, tables and quarantine are as if nothing had happened."""
    land, path, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    responses(spark).repartition(4).write.json(land)

    def run():
        stream = ingest.read_response_stream(spark, land, files_per_batch=2)
        ingest.collect(stream, path, state, buckets=3).awaitTermination()

    module = {"table": table, "ingest": ingest}[killed_in]
    real, left = module.write_note, [1]

    def fails_once(spark_, at, text):
        if "/1.json" in at or at.endswith("000001-00000.json"):
            if left.pop() if left else False:
                raise OSError("killed")
        real(spark_, at, text)

    monkeypatch.setattr(module, "write_note", fails_once)
    with pytest.raises(Exception, match="killed"):
        run()
    assert ingest.committed(spark, path) == [0]
    seen = ingest.quarantined(spark, path).count()
    run()
    assert len(ingest.committed(spark, path)) == 2
    want = sorted(map(str, ingest.postings_of(responses(spark)).collect()))
    assert sorted(map(str, ingest.current_postings(spark, path).collect())) == want
    bad = ingest.quarantined(spark, path)
    assert bad.schema == schemas.QUARANTINE and bad.count() > seen
    assert sorted(map(str, bad.collect())) == sorted(map(str, ingest.quarantine_of(responses(spark)).collect()))
    notes = ingest.batch_notes(spark, path)
    assert sum(n["rows"].get("quarantine", 0) for n in notes.values()) == 7
    run()
    assert sorted(map(str, ingest.current_postings(spark, path).collect())) == want


def test_no_responses(spark, tmp_path):
    (tmp_path / "land").mkdir()
    path = str(tmp_path / "out")
    stream = ingest.read_response_stream(spark, str(tmp_path / "land"))
    ingest.collect(stream, path, str(tmp_path / "state")).awaitTermination()
    assert ingest.current_postings(spark, path).count() == 0
    assert ingest.quarantined(spark, path).collect() == []

"""Large JSON arrays cut into elements at block boundaries anywhere."""

import json
import random

import pytest
from pyspark.sql import functions as F

from postlens import schemas
from postlens.sources import arrays, landing


@pytest.fixture
def small_splits(spark):
    """Files are split every so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "1")

    def split(size):
        spark.conf.set(names[0], str(size))

    yield split
    for n, v in old.items():
        spark.conf.set(n, v)


NASTY = ['}', '{', '],[', '"', '\\', '\\"', '\\\\', '}{"a":1},', "", "é漢 ", "a" * 700, '\\"}', "\n"]


def elements(n, seed):
    r = random.Random(seed)

    def value(depth):
        kind = r.randrange(6 if depth < 3 else 4)
        if kind < 3:
            return r.choice(NASTY)
        if kind == 3:
            return r.choice([None, 1.5, True, 12])
        if kind == 4:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return {r.choice(NASTY) + str(i): value(depth + 1) for i in range(r.randrange(4))}

    return [{"id": i, "v": value(0)} for i in range(n)]


@pytest.mark.parametrize("size", [64, 500, 7000])
@pytest.mark.parametrize("indent", [None, 2])
def test_cut_anywhere(spark, tmp_path, small_splits, size, indent):
    small_splits(size)
    rows = {f"f{k}.json": elements(n, k) for k, n in enumerate([60, 1, 0, 25])}
    for name, items in rows.items():
        mixed = [x for e in items for x in (e, None)] if name == "f3.json" else items
        (tmp_path / name).write_text(json.dumps(mixed, indent=indent, ensure_ascii=False) + " \n\n\t" * 40)
    paths = [str(tmp_path / n) for n in rows]
    if size == 64:
        assert arrays.pieces(spark, paths).select("path", "block").distinct().count() > 20
    got = arrays.read_elements(spark, paths).collect()
    for name, items in rows.items():
        mine = [json.loads(r.text) for r in got if r.path.endswith(name)]
        assert sorted(mine, key=lambda e: e["id"]) == items


def test_objects_without_array(spark, tmp_path, small_splits):
    small_splits(50)
    items = elements(30, 9)
    (tmp_path / "one.json").write_text(json.dumps(items[0]))
    (tmp_path / "lines.json").write_text("﻿" + "\n".join(map(json.dumps, items)))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n ")
    got = arrays.read_elements(spark, sorted(map(str, tmp_path.glob("*.json")))).collect()
    assert [json.loads(r.text) for r in got if r.path.endswith("one.json")] == items[:1]
    assert sorted((json.loads(r.text) for r in got if r.path.endswith("lines.json")),
                  key=lambda e: e["id"]) == items
    assert len(got) == 31


def test_several_tasks_read_one_file(spark, tmp_path, small_splits):
    """Large and small files of a landing folder give the same rows whichever way they are read."""
    rows = [{"job_id": str(i), "title": f"t{i} }}{{", "location": [{"label": "x"}], "skills": ["a", "b"],
             "salary_min": i / 2, "scraped_at": "2026-07-11T09:05:07", "description_snippet": "é" * (i % 50)}
            for i in range(400)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "big.json").write_text(json.dumps(
        rows[:390], ensure_ascii=False, separators=(",", ":")))
    (tmp_path / "small.json").write_text(json.dumps(rows[390:], separators=(",", ":")))
    (tmp_path / "_note.json").write_text("no data")
    (tmp_path / "other.txt").write_text("[1]")
    whole = landing.read_landing(spark, str(tmp_path))
    small_splits(4000)
    cut = landing.read_landing(spark, str(tmp_path), whole_bytes=5000)
    assert cut.schema == schemas.RAW == whole.schema
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and cut.count() == 400
    tasks = arrays.pieces(spark, [str(tmp_path / "deep" / "big.json")]) \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4

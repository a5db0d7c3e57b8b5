import os.path
import random

import pytest
from pyspark.sql import functions as F

from postlens.session import stage
from postlens.operators import dedupe, prefix

INTRO = "We are a company that has been building things for everyone since the start of it all. "


def stripped(spark, rows, **kw):
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)],
                               "i int, company string, description_clean string")
    found = prefix.company_prefixes(df, **kw)
    out = prefix.strip_prefixes(df, found).orderBy("i").collect()
    return [r["description_clean"] for r in out], found


def test_shared_intro_is_cut_at_its_last_space(spark):
    got, found = stripped(spark, [("a", INTRO + "Role one"), ("a", INTRO + "Rower two")])
    assert got == ["Role one", "Rower two"]
    row = found.collect()[0]
    assert (row["company"], row["rows"], row["prefix"]) == ("a", 2, INTRO.strip())
    assert prefix.prefix_log(found).collect()[0]["sample"] == INTRO[:80]


def test_identical_rows_keep_their_last_word(spark):
    got, _ = stripped(spark, [("a", INTRO + "end"), ("a", INTRO + "end")])
    assert got == ["end", "end"]


@pytest.mark.parametrize("rows", [
    [(None, INTRO + "x"), (None, INTRO + "y")],
    [("", INTRO + "x"), ("", INTRO + "y")],
    [("a", INTRO + "x"), ("b", INTRO + "y")],
    [("a", "q" * 59 + "x"), ("a", "q" * 59 + "y")],
    [("a", INTRO + "x"), ("a", INTRO + "y"), ("a", "")],
])
def test_left_unchanged(spark, rows):
    assert stripped(spark, rows)[0] == [t for _, t in rows]


def test_no_space_in_prefix(spark):
    assert stripped(spark, [("a", "q" * 60 + "x"), ("a", "q" * 60 + "y")])[0] == ["x", "y"]


def test_prefix_agrees_with_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(150):
        base = "".join(rng.choices("ab 😀é", k=rng.randint(0, 12)))
        for _ in range(rng.randint(1, 5)):
            rows.append((f"c{g}", base + "".join(rng.choices("ab 😀", k=rng.randint(0, 4)))))
    df = spark.createDataFrame(rows, "company string, description_clean string")
    got = {r["company"]: r["prefix"] for r in
           prefix.company_prefixes(df, min_chars=4).collect()}
    want = {}
    for c in {c for c, _ in rows}:
        texts = [t for d, t in rows if d == c]
        lcp = os.path.commonprefix(texts)
        if len(texts) > 1 and len(lcp) >= 4:
            want[c] = lcp.rpartition(" ")[0] if " " in lcp else lcp
    assert got == want


def test_broadcast_bound_has_another_way(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SENT", 0)
    got, _ = stripped(spark, [("a", INTRO + "Role one"), ("a", INTRO + "Rower two")])
    assert got == ["Role one", "Rower two"]


def test_keep_longest(spark):
    df = spark.createDataFrame(
        [("a", "t", "x" * 10, "1"), ("a", "t", "y" * 20, "2"), (None, "t", "z", "3"),
         (None, "t", "z", "4"), ("a", "u", "", "5")],
        "company string, title string, description_clean string, job_id string")
    kept = dedupe.keep_longest(df, ties=("job_id",))
    assert sorted(r["job_id"] for r in kept.collect()) == ["2", "3", "5"]
    row = dedupe.dedupe_counts(df).collect()[0]
    assert (row["rows_before"], row["rows_after"]) == (5, 3)


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("company"),
        F.lit("t").alias("title"), F.col("id").cast("string").alias("description_clean"),
        F.col("id").alias("job_id"))
    kept = dedupe.keep_longest(df, ties=("job_id",))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert kept.count() == 667


def test_prefix_moves_no_text(spark):
    """Between the tasks go digests, and one string per task and company."""
    rows = [("a", INTRO + f"Role {i} " + "x" * 3000) for i in range(40)] + [("b", "y" * 500)] * 3
    df = spark.createDataFrame(rows, "company string, description_clean string").repartition(6)
    df = stage(df, "rows")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = prefix.company_prefixes(df)
        moved = []

        def walk(node):
            if node.nodeName() in ("Exchange", "Sort"):
                moved.append(node.output().mkString(" "))
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(found._jdf.queryExecution().executedPlan())
        assert moved and not any("_text" in m or "description" in m for m in moved)
        assert {r["company"]: r["rows"] for r in found.collect()} == {"a": 40, "b": 3}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)

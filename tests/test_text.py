import html
import random

from pyspark.sql import functions as F

from postlens.functions import text


def cleaned(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in text.with_clean_text(df, "x", "y").orderBy("i").collect()]


def test_clean_text_hand_cases(spark):
    cases = {
        None: "",
        "": "",
        "<p>A &amp; B</p>\xa0\nC": "A & B C",
        "it’s “x” – y…": 'it\'s "x" - y...',
        "&rsquo;": "’",
        "&lt;b&gt;x": "x",
        "a < 5 and b > 2": "a 2",
        "3&ndash;5 years": "3–5 years",
        "This job is with X, a myGwork partner.\nPlease do not contact the recruiter directly. Role":
            "Role",
        "This job is with X. Please do not contact the recruiter directly.":
            "This job is with X. Please do not contact the recruiter directly.",
        "A THIS JOB IS WITH a mygwork b please do not contact the recruiter DIRECTLY B": "A B",
    }
    assert cleaned(spark, list(cases)) == list(cases.values())


def test_extra_boilerplate_span(column):
    spans = [("Apply (?:now|today) at .*?!", "apply")]
    got = column(lambda c: text.drop_boilerplate(c, spans), ["x APPLY NOW at \nacme! y", "x y"])
    assert got == ["x   y", "x y"]


def test_entities_agree_with_the_standard_decoder(column):
    rng = random.Random(1)
    parts = ["&amp;", "&lt", "&#65;", "&#x41;", "&notin;", "&notit;", "&bogus;", "&", ";", "a",
             "&copy2", "&#1114112;", "&nbsp;", "&amp;lt;", "é", " "]
    values = ["".join(rng.choices(parts, k=8)) for _ in range(300)] + [None]
    want = [None if v is None else html.unescape(v) for v in values]
    assert column(text.decode_entities, values) == want


def test_space_collapse_agrees_with_split_and_join(column):
    rng = random.Random(2)
    chars = "ab" + text.SPACES + "​᠎"
    values = ["".join(rng.choices(chars, k=12)) for _ in range(500)]
    assert column(text.collapse_spaces, values) == [" ".join(v.split()) for v in values]
    assert column(text.strip_ends, values) == [v.strip() for v in values]


def test_spaces_are_all_of_them():
    assert set(text.SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_truncate_flag(column):
    cases = {
        "abc…": True, "abc...  ": True, "abc": False, None: False, "": False,
        "x" * 401: True, "x" * 399 + ".": False, "x" * 400 + ".": False, "x" * 401 + '"': False,
        "x" * 401 + "! \n": False, "x" * 401 + "? ": False, " " * 401: False,
        "x" * 400: False, "x" * 200 + " " * 201: True,
    }
    assert column(text.looks_truncated, list(cases)) == list(cases.values())


def test_fold_case_reaches_the_extra_partners(column):
    assert column(text.fold_case, ["SQL İſı K"]) == ["sql isi k"]


def test_search_text(spark):
    df = spark.createDataFrame([("t", "d"), (None, "d"), ("t", None)], "a string, b string")
    got = [r[0] for r in df.select(text.search_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["t d", " d", "t "]

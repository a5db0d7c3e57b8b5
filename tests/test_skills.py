import random
import re

import pytest
from pyspark.sql import functions as F

from postlens.catalog.inputs import PROSE_TERMS
from postlens.functions import skills
from postlens.taxonomy import ROLE_SKILLS, category_table, compile_term, jvm_regex, taxonomy_table


def tagged(spark, values, taxonomy=ROLE_SKILLS):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [list(r["skills_extracted"]) for r in
            skills.with_skills(df, F.col("x"), taxonomy).orderBy("i").collect()]


def bands(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [(r["exp_min_years"], r["exp_max_years"]) for r in
            skills.with_experience(df, F.col("x")).orderBy("i").collect()]


def test_table_shape(spark):
    terms = taxonomy_table(spark)
    assert terms.count() == 105
    assert terms.filter("kind = 'literal'").count() == 86
    assert category_table(spark).groupBy("category").count().count() == 7
    assert category_table(spark).count() == 69


def test_hand_cases(spark):
    cases = {
        "scalable systems, excel at Scala": ["Excel", "Scala"],
        "excellent JavaScript": [],
        "Java and JavaScript": ["Java"],
        "NoSQL": ["NoSQL", "SQL"],
        "ML Ops": ["MLOps", "Machine Learning"],
        "agent for llm": ["Agents", "LLM"],
        "agent\nfor llm": ["LLM"],
        "C++ or c": ["C++"],
        "éml mĺ": ["Machine Learning"],
        "R for statistics": ["R", "Statistics"],
        "": [],
    }
    assert tagged(spark, list(cases)) == list(cases.values())


@pytest.mark.parametrize("taxonomy", [ROLE_SKILLS, PROSE_TERMS], ids=["roles", "prose"])
def test_agrees_with_python_patterns(spark, taxonomy):
    rng = random.Random(3)
    flat = {s: ps for group in taxonomy.values() for s, ps in group.items()}
    words = [re.sub(r"\\b|\\|\(\?.*", "", p) for ps in flat.values() for p in ps]
    words += ["stat", "vision", "ai", "ing", "script", "lent", "x", "é", "_", "1"]
    glue = [" ", "", "\n", "\r", " ", "\x85", "́", "-", "_", "é", ". "]
    values = []
    for _ in range(1500):
        out = ""
        for _ in range(rng.randint(1, 7)):
            w = rng.choice(words)
            out += rng.choice([w, w.upper(), w.title(), w.replace("s", "ſ"), w.replace("i", "İ")])
            out += rng.choice(glue)
        values.append(out)
    want = [sorted(s for s, ps in flat.items() if any(re.search(p, v, re.I) for p in ps))
            for v in values]
    assert tagged(spark, values, taxonomy) == want


def test_word_edges_keep_their_python_meaning(spark):
    patterns = [r"\bs?x\b", r"\w?\bx", r"c\+\+\b", r"\d\b", r"ml\b|\bdl", r"\bFoo", r"a\s+b"]
    rng = random.Random(4)
    values = ["".join(rng.choices("sxc+1mldFoo ab_é\x1ć-", k=6)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    found = df.select("i", *[F.lower("x").rlike(jvm_regex(p)).alias(f"p{j}")
                             for j, p in enumerate(patterns)]).orderBy("i").collect()
    for row, value in zip(found, values):
        want = [bool(re.search(p, value.lower(), re.I)) for p in patterns]
        assert list(row)[1:] == want, value


def test_needles_are_necessary():
    assert compile_term(r"\bagents?\b(?=.*(ai|llm))").needles == (("agent",), ("ai", "llm"))
    assert compile_term(r"ml\b|\bdl").needles == ()
    assert compile_term("fine-tun").regex is None


def test_experience(spark):
    cases = {
        "3-5 years": (3, 5), "3 to 5 years": (3, 5), "3+ years": (3, None),
        "minimum of 3 years": (3, None), "Minimum 4 year": (4, None), "3-5+ years": (3, 5),
        "5+ years … 2-3 years": (2, 3), "5 years": (None, None), "3–5 years": (None, None),
        "10\xa0-\n12 YEARS": (10, 12), "٣-٥ years": (3, 5), "99999999999+ years": (None, None),
        "9-2 years": (9, 2), None: (None, None), "": (None, None),
    }
    assert bands(spark, list(cases)) == list(cases.values())


def test_spans(column):
    got = column(lambda c: skills.match_spans(c, ["scala", "excel"], 3), [
        "very scalable and Scala", "excel excel", "a\nb scala\nc", "none", None])
    assert got == [["ry scalable"[:8 + 3], "nd scala"], ["excel ex", "el excel"], ["b scala"], [],
                   None]


def test_long_texts_get_the_same_skills(column):
    import random

    from postlens.catalog.inputs import PROSE_TERMS
    from postlens.functions.text import fold_case
    from postlens.taxonomy import ROLE_SKILLS, compile_taxonomy

    rng = random.Random(3)
    for taxonomy in (PROSE_TERMS, ROLE_SKILLS, {"Odd": {"cased": ["C[a-c]T"], "space": [r"a\sb"], "all": [r"q?"]}}):
        needles = [n for ts in compile_taxonomy(taxonomy).values() for t in ts for g in t.needles for n in g]
        joints = ["", " ", "\n", "_", "é", ".", "́", "3", "\x1c", "’"]
        texts = ["".join(rng.choice(needles + ["stat", "years", "cbt", "a", "b", "İ", "ſ"]) + rng.choice(joints)
                         for _ in range(rng.randint(0, 9))) for _ in range(400)] + [None, ""]
        plain, long = (column(lambda c: f(fold_case(c), taxonomy), texts)
                       for f in (skills.skill_names, skills.skill_names_long))
        assert plain == long

"""Tagging and spans by automaton."""

import random
import re

from pyspark.sql import functions as F

from postlens.catalog.inputs import PROSE_TERMS
from postlens.functions import automaton, skills
from postlens.taxonomy import ROLE_SKILLS

TEXTS = [
    "Python, SQL and R for statistics; R&D. JavaScript and Java, scalable Scala", "java script JAVA javascript",
    "Our CV team\nimage work", "cv of computer vision", "agents\nAI agent for autonomous agents and ai", "", None,
    "ÉCLAIR git digital .git git-flow _git", "C++ c/c++ Llama llamaindex llama index", "excel excellent excels EXCEL",
    "İstanbul K8S k8s ML ops mlops fine-tuning rag drag RAG ragtime", "x" * 5000 + " llm " + "gpt-4 gpt4" * 40,
]


def test_same_skills_as_generated_code(spark):
    r = random.Random(3)
    words = " ".join(t for t in TEXTS if t).split() + ["the", "nicht", "que", "tion", "ing", "license", "\n"]
    texts = TEXTS + [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(skills.fold_case(F.col("t")).alias("f"))
    for taxonomy in (ROLE_SKILLS, PROSE_TERMS, {}):
        both = df.select(skills.skill_names(F.col("f"), taxonomy).alias("a"),
                         automaton.skill_names(F.col("f"), taxonomy).alias("b")).collect()
        assert all((x["a"] or []) == x["b"] for x in both)


def test_ten_thousand_terms(spark):
    taxonomy = {"many": {f"skill {i}": [f"term{i}x", rf"\bword{i}\b"] for i in range(5000)}}
    text = "term17x word4999 xword3 word3y word12, TERM4321X " + "filler " * 200
    df = spark.range(500).select(F.lit(text).alias("t"))
    rows = skills.with_skills(df, F.col("t"), taxonomy).select("skills_extracted").distinct().collect()
    assert [r[0] for r in rows] == [["skill 12", "skill 17", "skill 4321", "skill 4999"]]


def test_spans(spark):
    texts = [t for t in TEXTS if t] * 2
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = automaton.skill_spans(df, F.col("t"), around=6).collect()
    flat = {s: ps for group in ROLE_SKILLS.values() for s, ps in group.items()}
    want = []
    for t in texts:
        folded = t.lower()
        for skill, patterns in flat.items():
            for m in re.finditer("|".join(f"(?:{p})" for p in patterns), folded):
                line = folded[:m.start()].rpartition("\n")[2][-6:], folded[m.end():].partition("\n")[0][:6]
                want.append((skill, line[0] + m[0] + line[1]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40

"""Skill tagging and experience bands over case-folded text."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache, reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import automaton
from postlens.functions.text import fold_case
from postlens.taxonomy import ROLE_SKILLS, Taxonomy, Term, compile_taxonomy, jvm_regex, python_regex

# Patterns that are compiled into the plan.
GENERATED = 400

# Experience patterns, the first one found anywhere in the text winning.
EXPERIENCE = [
    r"(\d+)\s*-\s*(\d+)\s*\+?\s*years?",
    r"(\d+)\s*to\s*(\d+)\s*years?",
    r"(\d+)\s*\+\s*years?",
    r"minimum\s*(?:of\s*)?(\d+)\s*years?",
]


def _found(folded: Column, terms: list[Term]) -> Column:
    def one(term: Term) -> Column:
        tests = [reduce(or_, [folded.contains(n) for n in group]) for group in term.needles]
        if term.regex is not None:
            tests.append(folded.rlike(term.regex))
        return reduce(and_, tests)

    return reduce(or_, map(one, terms))


def skill_names(folded: Column, taxonomy: Taxonomy = ROLE_SKILLS) -> Column:
    """Sorted names of the skills found. The names enter the array already in order, and taking
    away the null array drops those not found.

    More than `GENERATED` patterns are no longer one expression each: an automaton finds the same
    skills.
    """
    if sum(len(patterns) for skills in taxonomy.values() for patterns in skills.values()) > GENERATED:
        return automaton.skill_names(folded, taxonomy)
    hits = [F.when(_found(folded, terms), F.lit(skill))
            for skill, terms in compile_taxonomy(taxonomy).items()]
    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def skill_names_long(folded: Column, taxonomy: Taxonomy = ROLE_SKILLS) -> Column:
    """The same for long texts, of which each test would decode and walk through the whole: a text is
    decoded once, Python's search goes through it several times as fast, and a pattern is tried only
    where its needles occur."""
    tests = [(skill, [(t.needles, t.regex and python_regex(t.regex)) for t in terms])
             for skill, terms in compile_taxonomy(taxonomy).items()]

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        ready = [(skill, [(needles, regex and re.compile(regex)) for needles, regex in terms])
                 for skill, terms in tests]

        def one(text: str | None) -> list[str]:
            out = []
            if text is None:
                return out
            for skill, terms in ready:
                for needles, regex in terms:
                    if all(any(n in text for n in group) if len(group) > 1 else group[0] in text
                           for group in needles) and (regex is None or regex.search(text)):
                        out.append(skill)
                        break
            return out

        return pa.array([one(t.as_py()) for t in texts], pa.list_(pa.string()))

    return found(folded)


@lru_cache(maxsize=1)
def _digit_forms() -> tuple[str, str]:
    """Decimal digits of every script, and the ASCII digit each stands for."""
    digits = [c for c in map(chr, range(128, sys.maxunicode)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


def experience_numbers(folded: Column) -> Column:
    """Digit runs of the winning experience phrase: [min, max], [min], or null.

    The whole phrase is taken by one pass per pattern and the numbers are read from that short
    phrase. All four patterns need the word 'year', which is looked for first.
    """
    phrases = [F.nullif(F.regexp_extract(folded, jvm_regex(p), 0), F.lit("")) for p in EXPERIENCE]
    phrase = F.when(folded.contains("year"), F.coalesce(*phrases))
    return F.regexp_extract_all(F.translate(phrase, *_digit_forms()), F.lit(r"(\d+)"), F.lit(1))


def band_edge(numbers: Column, place: int) -> Column:
    """Number at `place` (0 or 1); null where absent or beyond the int range."""
    return F.get(numbers, F.lit(place)).try_cast("int")


def with_skills(df: DataFrame, text: Column, taxonomy: Taxonomy = ROLE_SKILLS,
                long_texts: bool = False) -> DataFrame:
    """Add skills_extracted and skill_count.

    The folded text gets its own projection, so it is made once per row and not once per pattern.
    """
    names = skill_names_long if long_texts else skill_names
    return (
        df.withColumn("_folded", fold_case(text))
        .withColumn("skills_extracted", names(F.col("_folded"), taxonomy))
        .withColumn("skill_count", F.size("skills_extracted"))
        .drop("_folded")
    )


def with_experience(df: DataFrame, text: Column) -> DataFrame:
    """Add exp_min_years and exp_max_years."""
    return (
        df.withColumn("_folded", fold_case(text))
        .withColumn("_numbers", experience_numbers(F.col("_folded")))
        .withColumn("exp_min_years", band_edge(F.col("_numbers"), 0))
        .withColumn("exp_max_years", band_edge(F.col("_numbers"), 1))
        .drop("_folded", "_numbers")
    )


def with_tags(df: DataFrame, text: Column, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """Skills and experience from one folded copy of the text."""
    return (
        df.withColumn("_folded", fold_case(text))
        .withColumn("_numbers", experience_numbers(F.col("_folded")))
        .withColumn("skills_extracted", skill_names(F.col("_folded"), taxonomy))
        .withColumn("skill_count", F.size("skills_extracted"))
        .withColumn("exp_min_years", band_edge(F.col("_numbers"), 0))
        .withColumn("exp_max_years", band_edge(F.col("_numbers"), 1))
        .drop("_folded", "_numbers")
    )


def match_spans(text: Column, patterns: list[str], around: int = 30) -> Column:
    """The folded text around each hit of a skill's patterns, within its line, as an array.

    Only the hits themselves are taken out, so two hits may share their surroundings.
    """
    pattern = F.lit("(?Ud)" + "|".join(f"(?:{_body(p)})" for p in patterns))
    folded = fold_case(text)
    hits = F.regexp_extract_all(folded, pattern, F.lit(0))
    between = F.split(folded, pattern, -1)

    def length(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

    def span(hit: Column, i: Column) -> Column:
        begin = length(between, i + 1) + length(hits, i)
        end = begin + F.length(hit)
        low = F.greatest(begin - around, F.lit(0))
        before = F.regexp_extract(F.substring(folded, low + 1, begin - low), r"[^\n]*\z", 0)
        after = F.regexp_extract(F.substring(folded, end + 1, F.lit(around)), r"\A[^\n]*", 0)
        return F.concat(before, hit, after)

    return F.transform(hits, span)


def _body(pattern: str) -> str:
    return jvm_regex(pattern).removeprefix("(?iUd)").removeprefix("(?Ud)")

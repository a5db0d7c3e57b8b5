"""Tagging by one automaton over all strings that patterns need.

The generated code of `skills` tests every pattern on every text, which suits a taxonomy of some
hundreds. Here a text is read once, however many terms there are: an automaton, sent to the tasks with
the taxonomy, reports which needles occur, and only patterns whose needles do are looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import fold_case
from postlens.taxonomy import ROLE_SKILLS, Taxonomy, compile_term


class Tagger:
    """Finds skills, or where they hit, in case-folded texts."""

    def __init__(self, taxonomy: Taxonomy):
        self.taxonomy = taxonomy
        self.skills = {s: list(ps) for skills in taxonomy.values() for s, ps in skills.items()}
        self._regexes: dict[str, re.Pattern] = {}

    def __getstate__(self) -> dict:
        return {"taxonomy": self.taxonomy, "skills": self.skills, "_regexes": {}}

    @cached_property
    def _index(self) -> tuple[ahocorasick.Automaton | None, dict[int, list[tuple]], list[tuple]]:
        """The automaton, the terms of each needle of their first group, and terms without needles."""
        numbers: dict[str, int] = {}
        of, always = defaultdict(list), []
        for skill, patterns in self.skills.items():
            for pattern in patterns:
                term = compile_term(pattern)
                groups = [[numbers.setdefault(n, len(numbers)) for n in g] for g in term.needles]
                entry = (skill, groups[1:], None if term.regex is None else pattern)
                for n in set(groups[0]) if groups else ():
                    of[n].append(entry)
                if not groups:
                    always.append(entry)
        automaton = None
        if numbers:
            automaton = ahocorasick.Automaton()
            for needle, n in numbers.items():
                automaton.add_word(needle, n)
            automaton.make_automaton()
        return automaton, of, always

    def _regex(self, pattern: str) -> re.Pattern:
        found = self._regexes.get(pattern)
        if found is None:
            found = self._regexes[pattern] = re.compile(pattern, re.IGNORECASE)
        return found

    def skills_in(self, folded: str) -> set[str]:
        automaton, of, always = self._index
        seen = {n for _, n in automaton.iter(folded)} if automaton is not None else set()
        out = set()
        for entries in [always, *(of[n] for n in seen if n in of)]:
            for skill, more, pattern in entries:
                if skill not in out and all(not seen.isdisjoint(g) for g in more) \
                        and (pattern is None or self._regex(pattern).search(folded)):
                    out.add(skill)
        return out

    def spans(self, folded: str, around: int) -> list[dict]:
        """Every hit of the skills found, leftmost first and none overlapping the one before of the same
        skill, with up to `around` characters on both sides within its line."""
        out = []
        for skill in sorted(self.skills_in(folded)):
            for hit in self._regex("|".join(f"(?:{p})" for p in self.skills[skill])).finditer(folded):
                begin, end = hit.span()
                before = folded[max(0, begin - around):begin].rpartition("\n")[2]
                after = folded[end:end + around].partition("\n")[0]
                out.append({"skill": skill, "span": before + hit[0] + after})
        return out


def skill_names(folded: Column, taxonomy: Taxonomy = ROLE_SKILLS) -> Column:
    """Sorted names of the skills found, as `skills.skill_names` gives them."""
    tagger = Tagger(taxonomy)

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(tagger.skills_in(t or "")) for t in texts.to_pylist()], pa.list_(pa.string()))

    return found(folded)


def skill_spans(df: DataFrame, text: Column, taxonomy: Taxonomy = ROLE_SKILLS, around: int = 30) -> DataFrame:
    """(skill, span) of every hit in every text."""
    tagger = Tagger(taxonomy)

    @F.arrow_udf("array<struct<skill: string, span: string>>")
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("skill", pa.string()), ("span", pa.string())]))
        return pa.array([tagger.spans(t or "", around) for t in texts.to_pylist()], kind)

    return df.select(F.inline(found(fold_case(text))))

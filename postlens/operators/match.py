"""Rank postings against résumés by shared skills."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from postlens.functions.labels import NO_MATCH, percent, skills_text
from postlens.session import stage

# How many matches are shown, and the shortest usable résumé.
TOP_MATCHES = 25
MIN_RESUME_CHARS = 100

# Posting sets that every task knows, of the most frequent and of the largest each. More give a tighter
# first cut, never another result.
SCOUTS = 1024
# Sets of a skill, on either side, that one block holds, and cells of their table computed at once.
BLOCK = 16_384
CELLS = 1 << 19
# A résumé set of more than a HOT-th of all résumés is dealt over PARTS tasks.
HOT = 200
PARTS = 64
# Above any whole percent, and above any number of skills.
PCT = 128
EVERY = 1 << 30


def coverage(matched: Column, required: Column) -> Column:
    """Whole percent of the required skills that are matched; 0 when none is required."""
    return F.when(required > 0, percent(matched, required, 0)).otherwise(F.lit(0.0)).cast("int")


def scores(wanted: Column, offered: Column) -> dict[str, Column]:
    """The score columns of one posting (`offered`) against one résumé (`wanted`)."""
    shared = F.array_intersect(offered, wanted)
    return {
        "matched_count": F.size(shared),
        "job_requires": F.size(F.array_distinct(offered)),
        "coverage_pct": coverage(F.size(shared), F.size(F.array_distinct(offered))),
        "matched_skills": skills_text(F.sort_array(shared), NO_MATCH),
    }


def score_postings(postings: DataFrame, resume_skills: Sequence[str] | Column,
                   skills: str = "skills_extracted") -> DataFrame:
    """Score every posting against one résumé. Narrow: nothing is shuffled."""
    wanted = resume_skills if isinstance(resume_skills, Column) else \
        F.array(*map(F.lit, resume_skills)).cast("array<string>")
    return postings.withColumns(scores(wanted, F.col(skills)))


def best_matches(scored: DataFrame, order: Sequence[str], n: int = TOP_MATCHES) -> DataFrame:
    """The n best of one résumé's scores; `order` settles ties by table position."""
    return scored.orderBy(F.desc("matched_count"), F.desc("coverage_pct"), *order).limit(n)


def match_many(resumes: DataFrame, postings: DataFrame, n: int = TOP_MATCHES,
               resume: str = "resume_id", posting: str = "posting_id",
               skills: str = "skills_extracted") -> DataFrame:
    """The n best postings of every résumé, exactly as scoring all pairs would rank them (`Matching`)."""
    return Matching(resumes, postings, n, resume, posting, skills).by_resume()


class Matching:
    """Résumés matched with postings by skill set.

    A score depends only on the two skill sets, so sets are matched, not rows:

    1. Postings collapse to their distinct skill sets, each keeping its first members. A set ranks
       its members by position only, so no member after the n-th can reach any top n. Résumés collapse
       to their sets too. Sets become bit words, rarest skill first.
    2. A bounded number of posting sets, the most frequent and the largest ones, go to all tasks as
       scouts. Any n real postings give a score that a résumé set's n-th best reaches at least, so the
       scouts give it a cut without moving anything.
    3. Sets meet by skill, for pairs that reach the cut; a pair sharing several skills is taken at its
       rarest one only. Sharing t skills with a set of m means sharing one of its m-t+1 rarest, on
       either side, so only those are looked up. How many sets of either side a skill has is counted
       first, and a skill with many is dealt over blocks of both sides, so one that a third of all
       sets hold is many tasks. A task gives the n best sets of its block for each résumé set, and the
       n best sets hold the n best postings: each of n better sets has a first member that beats
       everything in a worse set.
    4. Postings sharing nothing rank last, by position. A résumé set without a cut takes fillers from
       the first 2n postings, of which fewer than n can match.
    5. The n best go back to the résumés. A set that many résumés share is dealt over tasks.

    Columns of the résumés named in `keep` are staged beside their sets and come back with the matches.
    """

    def __init__(self, resumes: DataFrame, postings: DataFrame, n: int = TOP_MATCHES,
                 resume: str = "resume_id", posting: str = "posting_id",
                 skills: str = "skills_extracted", keep: Sequence[str] = ()):
        self.n, self.resume, self.posting, self.keep = n, resume, posting, list(keep)
        self.kind = postings.schema[posting].dataType
        self.sets = stage(_posting_sets(postings, posting, skills, 2 * n), "posting-sets")
        wanted = stage(resumes.select(resume, *keep, F.array_distinct(skills).alias("r_set")),
                       "resume-sets")
        # one row per skill of the taxonomy
        held = self.sets.select(F.explode("p_set").alias("skill")).filter(F.col("skill").isNotNull()) \
            .groupBy("skill").agg(F.count("*").alias("n")).orderBy("n", "skill").collect()
        self.counts = [row["n"] for row in held]
        self.bits = bits = _Bits([row["skill"] for row in held])
        self.key, self.p = bits.columns("r"), bits.columns("p")
        self.offered = self.sets.select(
            bits.ids("p_set").alias("ids"), F.size("p_set").alias("job_requires"), "members") \
            .select("*", *bits.encode("ids", "p"))
        self.coded = wanted.select(resume, *keep, bits.ids("r_set").alias("ids")) \
            .select("*", *bits.encode("ids", "r"))
        self.bounded = stage(self._cut(self._scouts()), "resume-cuts")

    def _scouts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, required skills and members of the scouts."""
        some = self.offered.select(*self.p, "job_requires", F.size("members").alias("n_members"))
        order = [F.col(p) for p in self.p]
        found = some.orderBy(F.desc("n_members"), *order).limit(SCOUTS) \
            .union(some.orderBy(F.desc("job_requires"), *order).limit(SCOUTS)).toArrow()
        words, one = np.unique(_words(found, self.p), axis=0, return_index=True)
        return words, found["job_requires"].to_numpy()[one], found["n_members"].to_numpy()[one]

    def _cut(self, scouts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
        """Résumé sets with what their n-th best reaches at least (`needed` skills, `cut` the whole
        score; 0 if unknown), the skills they are looked up by, and the size of the largest posting set
        that reaches the cut with no more than the needed skills."""
        sets = self.coded.groupBy(*self.key).agg(F.first("ids").alias("ids"), F.count("*").alias("resumes"))
        key, n = self.key, self.n
        schema = StructType([
            *sets.select(*key, "resumes").schema.fields, *StructType.fromDDL(
                "needed int, cut int, largest int, visits array<int>").fields])

        def cutting(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, required, members = scouts
            for batch in it:
                for at in range(0, len(batch), 256):
                    b = batch.slice(at, 256)
                    score = _scores(_shared(_words(b, key), words), required)
                    order = np.argsort(-score, axis=1, kind="stable")
                    best = np.take_along_axis(score, order, axis=1)
                    reached = np.cumsum(np.where(best > 0, members[order], 0), axis=1) >= n
                    cut = np.where(reached.any(axis=1), np.take_along_axis(
                        best, reached.argmax(axis=1)[:, None], axis=1)[:, 0], 0) if best.size \
                        else np.zeros(len(b), np.int64)
                    needed = np.maximum(cut // PCT, 1)
                    visits = [ids[:max(0, len(ids) - t + 1)] for ids, t in
                              zip(b["ids"].to_pylist(), needed.tolist(), strict=True)]
                    # a little more than needed / size * 100 >= percent - 0.5 allows
                    largest = np.where(cut % PCT > 0, np.ceil(
                        needed * 100 / np.maximum(cut % PCT - 0.5, 0.5)), EVERY).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(b[k] for k in key), b["resumes"], pa.array(needed, pa.int32()),
                         pa.array(cut, pa.int32()), pa.array(largest, pa.int32()),
                         pa.array(visits, pa.list_(pa.int32()))], names=schema.names)

        return sets.mapInArrow(cutting, schema)

    def _index(self) -> DataFrame:
        """Posting sets by each of their skills; `after`: how many skills they have from it on."""
        return self.offered.select(
            *self.p, "job_requires", F.slice("members", 1, self.n).alias("members"), F.size("ids").alias("m"),
            F.posexplode("ids").alias("at", "skill")).withColumn("after", F.col("m") - F.col("at")).drop("m", "at")

    def _visits(self) -> DataFrame:
        """Résumé sets by the skills they are looked up by. `last`: a pair taken at this skill shares no
        more than the needed ones."""
        return self.bounded.select(
            *self.key, "needed", "cut", "largest", F.size("visits").alias("m"),
            F.posexplode("visits").alias("at", "skill")) \
            .withColumn("last", F.col("at") == F.col("m") - 1).drop("m", "at")

    def meetings(self) -> DataFrame:
        """`skill`, `pairs`: how many pairs of sets are looked at by each skill."""
        index = self._index().groupBy("skill", "after", "job_requires").agg(F.count("*").alias("p"))
        visits = self._visits().groupBy("skill", "needed", "largest", "last").agg(F.count("*").alias("r"))
        small, spare = F.col("job_requires") <= F.col("largest"), F.col("after") - F.col("needed")
        looked_at = F.when(F.col("last"), small).otherwise((spare > 0) | ((spare == 0) & small))
        return index.join(visits, "skill").filter(looked_at).groupBy("skill") \
            .agg(F.sum(F.col("p") * F.col("r")).alias("pairs"))

    def _met(self) -> DataFrame:
        """The n best posting sets of each résumé set in each block."""
        visited = self._visits().groupBy("skill").agg(F.count("*").alias("n")).collect()
        blocks = self.coded.sparkSession.createDataFrame(
            [(r["skill"], -(-self.counts[r["skill"]] // BLOCK), -(-r["n"] // BLOCK)) for r in visited],
            "skill int, p_blocks int, r_blocks int")

        def dealt(df: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
            return df.join(F.broadcast(blocks), "skill") \
                .withColumn(own[0], F.pmod(F.xxhash64(*by), F.col(own)).cast("int")) \
                .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))) \
                .drop("p_blocks", "r_blocks").groupBy("skill", "p", "r")

        index = dealt(self._index(), "p_blocks", "r_blocks", self.p)
        visits = dealt(self._visits(), "r_blocks", "p_blocks", self.key)
        schema = StructType([
            *self.bounded.select(*self.key).schema.fields, *self.offered.select(*self.p).schema.fields,
            *StructType.fromDDL("job_requires int, matched_count int, coverage_pct int").fields,
            StructField("members", ArrayType(self.kind))])
        key, p, n = self.key, self.p, self.n
        return index.cogroup(visits).applyInArrow(
            lambda at, left, right: _best_of_block(at[0].as_py(), left, right, key, p, n, schema.names), schema)

    def by_set(self) -> DataFrame:
        """The résumé sets' words, `place`, the posting, its required skills and the score."""
        members = F.explode("members").alias("posting")
        rank_sets = Window.partitionBy(*self.key).orderBy(
            F.desc("matched_count"), F.desc("coverage_pct"), F.get("members", F.lit(0)))
        matched = self._met().withColumn("_i", F.row_number().over(rank_sets)).filter(F.col("_i") <= self.n) \
            .select(*self.key, *self.p, "job_requires", "matched_count", "coverage_pct", members)
        first = (
            self.offered.select(*self.p, "job_requires", members).orderBy("posting").limit(2 * self.n)
            .agg(F.collect_list(F.struct(*self.p, "job_requires", "posting"))).scalar()
        )
        fillers = (
            self.bounded.filter("cut = 0").select(*self.key, F.inline_outer(first))
            .filter(F.col("posting").isNotNull())
            .withColumn("matched_count", self.bits.shared()).filter(F.col("matched_count") == 0)
            .withColumn("coverage_pct", F.lit(0))
        )
        rank = Window.partitionBy(*self.key).orderBy(
            F.desc("matched_count"), F.desc("coverage_pct"), "posting")
        return (
            matched.unionByName(fillers)
            .withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= self.n)
            .select(*self.key, "place", F.col("posting").alias(self.posting), "matched_count",
                    "job_requires", "coverage_pct",
                    skills_text(self.bits.names_shared(), NO_MATCH).alias("matched_skills"))
        )

    def to_resumes(self, by_set: DataFrame) -> DataFrame:
        """`by_set`, one row per résumé set, joined onto the résumés; what they keep moves here once."""
        return spread_join(self.coded.drop("ids"), by_set, self.key, self.resume,
                           self.bounded.select(*self.key, F.col("resumes").alias("n"))).drop(*self.key)

    def by_resume(self) -> DataFrame:
        best = self.by_set().groupBy(*self.key).agg(F.collect_list(F.struct(
            "place", self.posting, "matched_count", "job_requires", "coverage_pct", "matched_skills"))
            .alias("best"))
        return self.to_resumes(best).select(self.resume, F.inline("best"))


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], id: str, counts: DataFrame) -> DataFrame:
    """Inner join of many rows with one row per key, where `counts` says how many rows (`n`) a key has.

    Keys with more than a `HOT`-th of all rows, fewer than `HOT` then, go to all tasks; their rows are
    dealt over `PARTS` tasks by `id`, and the one row they meet is sent to each of these.
    """
    total = counts.agg(F.sum("n")).scalar()
    hot = F.broadcast(counts.filter(F.col("n") * HOT > total).select(*on, F.lit(PARTS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = left.join(hot, on, "left") \
        .withColumn("part", F.pmod(F.xxhash64(id), parts).cast("int")).drop("parts")
    repeated = right.join(hot, on, "left") \
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(repeated, [*on, "part"]).drop("part")


def _words(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([table[c].to_numpy(zero_copy_only=False) for c in names]) \
        .astype(np.int64).view(np.uint64).reshape(len(table), len(names))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared skills of each of `a` with each of `b`."""
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] & b[None, :, w])
    return out


def _scores(shared: np.ndarray, required: np.ndarray) -> np.ndarray:
    """Shared skills, then whole percent, as one number. Divides first, as `percent` does."""
    return shared * PCT + np.rint(shared / np.maximum(required, 1) * 100).astype(np.int64)


def _best_of_block(skill: int, index: pa.Table, visits: pa.Table, key: list[str], p: list[str], n: int,
                   names: list[str]) -> pa.Table:
    """For each résumé set the n best of the posting sets that it first shares `skill` with."""
    index = index.append_column("first", pc.list_element(index["members"], 0))
    order = np.empty(len(index), np.int64)
    order[pc.sort_indices(index["first"]).to_numpy()] = np.arange(len(index))
    before = np.array([(1 << max(0, min(_Bits.SIZE, skill - w * _Bits.SIZE))) - 1
                       for w in range(len(key))], np.uint64)
    offered, after, required = _words(index, p), index["after"].to_numpy(), index["job_requires"].to_numpy()
    wanted, needed, cut = _words(visits, key), visits["needed"].to_numpy(), visits["cut"].to_numpy()
    last, largest = visits["last"].to_numpy(), visits["largest"].to_numpy()
    r_found, p_found, score_found = [], [], []

    def meet(sets: np.ndarray, limit: np.ndarray, rows: np.ndarray, reach: np.ndarray,
             least: np.ndarray) -> None:
        """Résumé sets `rows` with the posting sets up to where `limit`, which falls, is their `reach`,
        if these have at least so many skills left."""
        rows = rows[np.argsort(reach[rows], kind="stable")]
        able = np.searchsorted(-limit, -reach[rows], side="right")
        at = 0
        while at < len(rows) and (most := int(able[at])):
            some = rows[at:at + max(1, CELLS // most)]
            at += len(some)
            near = sets[:most]
            score = _scores(_shared(wanted[some], offered[near]), required[near])
            wins = _shared(wanted[some] & before, offered[near]) == 0
            wins &= (score >= np.maximum(cut[some], 1)[:, None]) & (after[near] >= least[some, None])
            # the better score first, then the earlier posting
            ranked = np.where(wins, score << 32 | len(order) - order[near], 0)
            if most > n:
                wins &= ranked >= np.partition(ranked, most - n, axis=1)[:, most - n, None]
            r, q = np.nonzero(wins)
            r_found.append(some[r])
            p_found.append(near[q])
            score_found.append(score[r, q])

    by_size = np.argsort(required, kind="stable")
    meet(by_size, -required[by_size], np.flatnonzero(last), -largest, needed)
    # more skills than needed may be shared only where more are left; else the size decides as well
    by_after = np.argsort(-after, kind="stable")
    meet(by_after, after[by_after], np.flatnonzero(~last), needed + 1, needed + 1)
    for t in np.unique(needed[~last]).tolist():
        even = by_size[after[by_size] == t]
        meet(even, -required[even], np.flatnonzero(~last & (needed == t)), -largest, needed)
    r, q, score = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (r_found, p_found, score_found))
    return pa.table([*(visits[k].take(pa.array(r)) for k in key), *(index[k].take(pa.array(q)) for k in p),
                     index["job_requires"].take(pa.array(q)), pa.array(score // PCT, pa.int32()),
                     pa.array(score % PCT, pa.int32()), index["members"].take(pa.array(q))], names=names)


def _posting_sets(postings: DataFrame, posting: str, skills: str, keep: int) -> DataFrame:
    """(p_set, members): distinct skill sets with their first `keep` postings."""
    first = Window.partitionBy("p_set").orderBy("posting")
    return (
        postings.select(F.col(posting).alias("posting"),
                        F.sort_array(F.array_distinct(skills)).alias("p_set"))
        .withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= keep)
        .groupBy("p_set").agg(F.sort_array(F.collect_list("posting")).alias("members"))
    )


class _Bits:
    """Skill sets as 63-bit words over a fixed name list."""

    SIZE = 63

    def __init__(self, names: Sequence[str]) -> None:
        self.words = max(1, -(-len(names) // self.SIZE))
        self._names = [_literal(names[w * self.SIZE:(w + 1) * self.SIZE])
                       for w in range(self.words)]
        self._all = _literal(names)

    def columns(self, side: str) -> list[str]:
        return [f"{side}{w}" for w in range(self.words)]

    def ids(self, skills: str) -> Column:
        """Positions of the set's skills in the name list, ascending; unknown names left out."""
        places = F.transform(skills, lambda s: F.array_position(self._all, s).cast("int") - 1)
        return F.sort_array(F.filter(places, lambda i: i >= 0))

    def encode(self, ids: str, side: str) -> list[Column]:
        def word(w: int) -> Column:
            mine = F.filter(ids, lambda i: F.floor(i / self.SIZE) == w)
            bit = F.transform(mine, lambda i: F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), i % self.SIZE))
            zero = F.lit(0).cast("bigint")
            # declared never null, else every join on it would test for that
            return F.coalesce(F.aggregate(bit, zero, lambda a, b: a.bitwiseOR(b)), zero)

        return [word(w).alias(name) for w, name in enumerate(self.columns(side))]

    def _both(self) -> list[Column]:
        return [F.col(f"r{w}").bitwiseAND(F.col(f"p{w}")) for w in range(self.words)]

    def shared(self) -> Column:
        """Number of shared skills."""
        return reduce(add, [F.bit_count(x).cast("int") for x in self._both()])

    def names_shared(self) -> Column:
        """Names of the shared skills, sorted."""
        def held(names: Column, word: Column) -> Column:
            return F.filter(names, lambda _, i: F.getbit(word, i) == 1)

        return F.sort_array(F.concat(*map(held, self._names, self._both())))


def _literal(names: Sequence[str]) -> Column:
    """The names as one constant array."""
    if not names:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x01".join(names)), "\x01")

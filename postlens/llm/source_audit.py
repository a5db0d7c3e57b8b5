"""How far the sources of a language part from each other in the words they use.

1. A shard is a few megabytes of text in one buffer. Pointers to the starts of its terms are sorted by
   the terms they point at (`multikey_sort`): by eight bytes at a time, and only runs that are still
   equal and not at their end go on to the next eight. A run of equal pointers is a term; the documents
   in it give occurrences and document frequency by group.
2. Spark adds the shards up by (language, source, term) and keeps the terms of enough documents.
3. Shares are compared exactly, in whole numbers. A source has no row for terms that it lacks: all of
   them have one and the same share there. So for each pair of sources the terms of either are summed,
   by slices of the vocabulary, and the rest counts as often as there are such terms.

Documents are rows: repeated ids count each time. Null text, language and source are ''. A text without
terms counts for its group, which is reported with zero counts. Results have a row for each pair of
sources of a language, so what is kept for a language's groups (one row each) is small beside them.
Ties rank by item. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.llm.minhash import sliced
from postlens.session import stage

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of text of a shard.
SHARD_BYTES = 8 << 20
#: Cells (terms x sources) of a slice of the vocabulary.
SLICE_CELLS = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of terms: ASCII letters and all of non-ASCII characters.
OF_TERM = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])
#: The first n of eight bytes, big-endian.
FIRST = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], np.uint64)

COUNTS = "lang string, source string, term string, n long, docs long"
APART = "lang string, source string, other string, value long"


def multikey_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings `data[start:end]`, and which places of it begin a run of equal ones.

    `data` has eight bytes of padding, and strings hold no zero byte.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,))
    order, left = np.arange(len(starts)), np.arange(len(starts))
    opens = np.zeros(len(starts), bool)
    opens[:1] = True
    depth, run = 0, None
    while len(left):
        at = order[left]
        rest = ends[at] - starts[at] - depth
        seen = np.clip(rest, 0, 8)
        key = words[np.where(seen > 0, starts[at] + depth, 0)].astype(np.uint64) & FIRST[seen]
        by = np.argsort(key) if run is None else np.lexsort((key, run))
        order[left], key, rest = at[by], key[by], rest[by]
        parts = key[1:] != key[:-1]
        if run is not None:
            parts |= run[1:] != run[:-1]
        opens[left[1:]] |= parts
        head = np.concatenate([[True], parts])
        number = np.cumsum(head) - 1
        goes_on = (np.bincount(number) > 1) & (np.bincount(number, rest > 8) > 0)
        stays = goes_on[number]
        left, run, depth = left[stays], number[stays], depth + 8
    return order, opens


def shard_terms(texts: list[bytes], group: np.ndarray) -> tuple[list[bytes], tuple | None]:
    """The terms of a shard, and for each (term, group) in it its numbers, occurrences and documents."""
    by = np.argsort(group, kind="stable")
    texts, group = [texts[i] for i in by], group[by]
    raw = np.frombuffer(b"\0".join([*texts, bytes(8)]), np.uint8)
    data, inside = LOWER[raw], OF_TERM[raw]
    change = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = change[0::2], change[1::2]
    if not len(starts):
        return [], None
    order, opens = multikey_sort(data, starts, ends)
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_ends, starts, side="right")
    # documents are in the order of their groups, so sorting by (term, document) sorts by group too
    pair = np.sort((np.cumsum(opens) - 1) * len(texts) + doc[order])
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(first, append=len(pair))
    term, of = pair[first] // len(texts), group[pair[first] % len(texts)]
    head = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    heads = order[opens]
    whole = data.tobytes()
    terms = [whole[s:e] for s, e in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)]
    return terms, (term[head], of[head], np.add.reduceat(n, head), np.diff(head, append=len(first)))


def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sliced(it, SHARD_BYTES):
        names = pa.StructArray.from_arrays(
            [table[c].combine_chunks() for c in ("lang", "source")], ["lang", "source"])
        pairs = [(x["lang"], x["source"]) for x in names.to_pylist()]
        numbers = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        group = np.fromiter((numbers[p] for p in pairs), np.int64, len(pairs))
        terms, found = shard_terms([x or b"" for x in table["text"].cast(pa.binary()).to_pylist()],
                                   group)
        if not terms:
            continue
        term, of, n, docs = found
        each = list(numbers)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in each], pa.string()).take(of),
             pa.array([p[1] for p in each], pa.string()).take(of),
             pa.array(terms, pa.binary()).cast(pa.string()).take(term),
             pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """`lang`, `source`, `term`, `n`, the language's `lang_n`, and `leads` (1 on one row of each
    term of a language), for the terms in at least `least_docs` documents of a language."""
    each = docs.mapInArrow(counted, COUNTS).groupBy("lang", "source", "term") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    return each.select(
        "lang", "source", "term", "n", F.sum("n").over(over).alias("lang_n"),
        F.sum("docs").over(over).alias("lang_docs"),
        (F.row_number().over(over.orderBy("source")) == 1).cast("int").alias("leads"),
    ).where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); the product is decimal, as it passes 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def grouped(docs: DataFrame, present: DataFrame) -> DataFrame:
    """One row per (language, source): `total` and the language's `lang_total` and `terms`, the share
    `least` of terms that the source lacks, and in how many `slices` the language's terms are."""
    own = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = present.groupBy("lang").agg(
        F.sum("leads").alias("terms"), F.sum(F.col("leads") * F.col("lang_n")).alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    none = {"total": 0, "terms": 0, "lang_total": 0}
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left") \
        .join(sources, "lang").fillna(none) \
        .withColumn("least", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))) \
        .withColumn("slices", F.ceil(F.col("terms") * F.col("sources") / SLICE_CELLS).cast("int"))


def slice_gaps(table: pa.Table) -> pa.Table:
    """What the terms of one slice add to the gap of each pair of sources, above the gap that terms
    lacking in both have. Rows without term give the shares of lacking terms of all sources."""
    lang = table["lang"][0].as_py()
    given = table.filter(pc.is_null(table["term"])).sort_by("source")
    sources = given["source"].to_pylist()
    least = given["share"].to_numpy()
    rows = table.filter(pc.is_valid(table["term"]))
    number = {s: i for i, s in enumerate(sources)}
    of = np.fromiter((number[s] for s in rows["source"].to_pylist()), np.int64, len(rows))
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    shares = np.tile(least, (int(term.max(initial=-1)) + 1, 1))
    there = np.zeros(shares.shape, bool)
    shares[term, of], there[term, of] = rows["share"].to_numpy(), True
    added = np.zeros((len(sources), len(sources)), np.int64)
    for s in range(len(sources)):
        mine = there[:, s]
        p, q = shares[mine, s, None], shares[mine]
        base = (least[s] - least) ** 2 // (least[s] + least)
        more = (p - q) ** 2 // (p + q) - base
        added[s] += more.sum(axis=0)
        added[:, s] += np.where(there[mine], 0, more).sum(axis=0)
    s, o = np.nonzero(added)
    return pa.table({
        "lang": pa.array([lang] * len(s), pa.string()),
        "source": pa.array(sources, pa.string()).take(s), "other": pa.array(sources, pa.string()).take(o),
        "value": pa.array(added[s, o], pa.int64())})


def source_gaps(present: DataFrame, groups: DataFrame) -> DataFrame:
    """`lang`, `source`, `other`, `value` for every two sources of a language."""
    slot = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    lacking = groups.where("slices > 0").select(
        "lang", slot.alias("slice"), "source", F.lit(None).cast("string").alias("term"),
        F.col("least").alias("share"))
    terms = present.join(groups, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "source", "term",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("share"))
    sums = terms.unionByName(lacking).groupBy("lang", "slice") \
        .applyInArrow(lambda table: slice_gaps(table), APART) \
        .groupBy("lang", "source", "other").agg(F.sum("value").alias("added"))
    a = groups.select("lang", "source", "terms", F.col("least").alias("p"))
    b = groups.select("lang", F.col("source").alias("other"), F.col("least").alias("q"))
    base = F.col("terms") * gap(F.col("p"), F.col("q")) + F.coalesce("added", F.lit(0))
    return a.join(b, "lang").where("source <> other").join(sums, ["lang", "source", "other"], "left") \
        .select("lang", "source", "other",
                F.when(F.col("terms") > 0, base).otherwise(0).cast("long").alias("value"))


def prominent(present: DataFrame, groups: DataFrame) -> DataFrame:
    """`lang`, `source`, `term`, `value`: terms with a larger share in a source than in its language."""
    n = F.col("terms")
    return present.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), n).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), n).alias("q"),
    ).where("p > q").select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`. Part `pair`: the other sources of the
    language by their distance; part `term`: the `top` terms that stand out in the source."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    present = stage(term_counts(docs, least_docs), "terms-by-source")
    groups = stage(grouped(docs, present), "source-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str, item: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value") \
            .withColumn("rank", F.row_number().over(order))

    return ranked(source_gaps(present, groups), "pair", "other").unionByName(
        ranked(prominent(present, groups), "term", "term").where(F.col("rank") <= top))

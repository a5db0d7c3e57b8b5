"""Spelling variants: words one inserted, deleted or replaced letter apart, found in a trie of counts.

1. Words (runs of Latin letters) are counted over all documents; of frequent ones a fixed share has
   lost a letter, so that variants occur.
2. A word's vector is its length and how often it has letters of each group (`GROUPS`). Words one edit
   apart differ by a surplus of at most one in one place and a deficit of at most one in another.
   Words arranged by successive places of their vectors form a trie. A depth-first search carries all
   words that may still have a partner below a node: a word goes on to a child if the difference in
   that place is covered by what is left of its budget, one surplus and one deficit. Of two words only
   one finds the other: the surplus must be spent first, and a word looks for longer ones, never for
   shorter ones.
3. The search runs twice. Over the top of the trie, planned from counts of vector prefixes, it sends
   each word to the cells (subtrees of at most `CELL_WORDS` words) where a partner may be. Within a
   cell it goes down to leaves of at most `LEAF_WORDS` words, where pairs are verified letter by
   letter; letters that occur (and occur twice) as bits rule most out before. Where many words share a
   leaf, as with strings over few letters, they meet by the rest after a letter is taken out, so no
   leaf compares all its pairs.
4. Each word's best partner becomes its form. A form has ten times the occurrences, so chains of forms
   are short, and a few joins that double the steps lead to the last one.

The driver holds counts of the prefixes of overfull subtrees: some dozens for each `CELL_WORDS` words.

Null text has no words; a null id counts as ''. Documents of the same id and text count each. Long
words differ by saturated counts (255), which still fits the budgets. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.session import stage

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: One in so many (document, word) pairs loses a letter.
DAMAGED = 31
#: A form occurs at least so many times as often as the word.
TIMES = 10
CELL_WORDS = 16_384
LEAF_WORDS = 24
#: Pairs of a leaf that are compared one by one.
LEAF_PAIRS = 1 << 18
#: Words up to this length are compared as rows of a matrix.
SHORT = 48
#: Places of the vector that one step of planning adds.
STEP = 4

RUN = "([a-zÀ-ÿ]{%d,})" % LEAST_LETTERS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of each place after the length; all others belong to the last.
GROUPS = ["e", "a", "i", "n", "r", "s", "t", "o", "l", "ud", "cm", "pbvf", "gqhk", "jwxyz", ""]
PLACES = 1 + len(GROUPS)

#: State after a difference of -1, 0 or 1: nothing spent / surplus / both, of equally long words;
#: nothing spent / surplus, when looking for longer ones. -1: no partner there.
NEXT = np.array([[-1, 0, 1], [2, 1, -1], [-1, 2, -1], [-1, 3, 4], [-1, 4, -1]], np.int8)
SAME, LONGER = 0, 3

ROUTED = "cell int, home boolean, word string, n long"
LINK = "word string, n long, near string, near_n long"


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`word`, `n` of the words with enough letters and occurrences."""
    key = F.coalesce(docs[id].cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(
        F.regexp_extract_all(F.translate(docs[text], UPPER, LOWER), F.lit(RUN), 1)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select("run", h.alias("h")) \
        .select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")) \
        .where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= LEAST_COUNT)


GROUP_OF = np.full(256, len(GROUPS) - 1, np.int64)
for _i, _letters in enumerate(GROUPS):
    GROUP_OF[[ord(x) for x in _letters]] = _i


def vectors(words: list[bytes]) -> np.ndarray:
    """Length and letter-group counts, at most 255."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)) * len(GROUPS), lengths)
    letters = np.frombuffer(b"".join(words), np.uint8)
    counts = np.bincount(of + GROUP_OF[letters], minlength=len(words) * len(GROUPS))
    both = np.column_stack([lengths, counts.reshape(len(words), len(GROUPS))])
    return np.minimum(both, 255).astype(np.uint8)


def latin(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


class Trie:
    """Vectors in order, so that a node is a range of them; `weight` says how many words a vector is.

    `search` goes depth first and stops at nodes of at most `least` words.
    """

    def __init__(self, rows: np.ndarray, weight: np.ndarray, least: int):
        self.rows, self.least = rows, least
        self.upto = np.concatenate([[0], np.cumsum(weight)])

    def search(self, queries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Begin and end of each node where it stops, the queries that get there and their states."""
        every = np.arange(len(queries))
        wide = queries.astype(np.int16)
        if len(self.rows):
            yield from self._below(0, len(self.rows), 0, wide, every, np.full(len(queries), SAME, np.int8))

    def _below(self, lo, hi, place, queries, who, state):
        if self.upto[hi] - self.upto[lo] <= self.least or place == self.rows.shape[1]:
            yield lo, hi, who, state
            return
        column = self.rows[lo:hi, place]
        cuts = [lo, *(np.flatnonzero(column[1:] != column[:-1]) + lo + 1).tolist(), hi]
        mine = queries[who, place]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            apart = int(self.rows[a, place]) - mine
            if place == 0:
                near = (apart == 0) | (apart == 1)
                after = np.where(apart[near] == 0, SAME, LONGER).astype(np.int8)
            else:
                near = np.flatnonzero(np.abs(apart) <= 1)
                after = NEXT[state[near], apart[near] + 1]
                near, after = near[after >= 0], after[after >= 0]
            if len(after):
                yield from self._below(a, b, place + 1, queries, who[near], after)


def planned(words: DataFrame, cell_words: int) -> Trie:
    """The top of the trie. `words` has `vector`; only prefixes of overfull subtrees are looked into."""
    rows, weight = np.zeros((0, PLACES), np.uint8), np.zeros(0, np.int64)
    inside = words
    for place in range(STEP, PLACES + STEP, STEP):
        prefix = F.substring("vector", 1, min(place, PLACES))
        found = inside.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        n = found["n"].to_numpy()
        full = (n > cell_words) & (place < PLACES)
        keep = found.filter(pa.array(~full))["prefix"].to_pylist()
        rows = np.vstack([rows, np.frombuffer(b"".join(x.ljust(PLACES, b"\0") for x in keep), np.uint8)
                          .reshape(-1, PLACES)])
        weight = np.concatenate([weight, n[~full]])
        if not full.any():
            break
        overfull = found.filter(pa.array(full)).select(["prefix"])
        spark = words.sparkSession
        inside = words.join(F.broadcast(spark.createDataFrame(overfull)),
                            prefix == F.col("prefix"), "left_semi")
    order = np.lexsort(rows.T[::-1])
    return Trie(rows[order], weight[order], cell_words)


def with_vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        v = vectors(latin(b["word"]))
        yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array([x.tobytes() for x in v], pa.binary())],
                                         names=["word", "n", "vector"])


def routed(it: Iterator[pa.RecordBatch], top: Trie) -> Iterator[pa.RecordBatch]:
    """Each word with the cells where it has its home or may have a partner."""
    for b in it:
        if not len(b):
            continue
        v = np.frombuffer(b"".join(b["vector"].to_pylist()), np.uint8).reshape(-1, PLACES)
        for cell, _, who, state in top.search(v):
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(who), cell), pa.int32()), pa.array(state == SAME),
                 b["word"].take(at), b["n"].take(at)], names=["cell", "home", "word", "n"])


def one_edit(u: bytes, v: bytes) -> bool:
    """Whether two different words are one edit apart."""
    u, v = sorted((u, v), key=len)
    i = next((i for i, x in enumerate(u) if x != v[i]), len(u))
    return u[i + 1:] == v[i + 1:] if len(u) == len(v) else u[i:] == v[i + 1:]


class Cell:
    """Words of a cell: its own, `home`, and others that may have a partner among them."""

    def __init__(self, words: list[bytes], home: np.ndarray):
        v = vectors(words)
        own = np.flatnonzero(home)
        self.words, self.vectors, self.home = words, v, home
        self.own = own[np.lexsort(v[own].T[::-1])]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.matrix = np.array([w[:SHORT + 1] for w in words], f"S{SHORT + 1}").view(np.uint8) \
            .reshape(len(words), SHORT + 1)
        self.marks = self.letters()

    def letters(self) -> np.ndarray:
        """Bits for the letters of a word, other ones for its second and third of a kind: one edit
        changes two bits at most."""
        of = np.repeat(np.arange(len(self.words)), self.lengths)
        letter = np.frombuffer(b"".join(self.words), np.uint8).astype(np.int64)
        kind, n = np.unique(of << 8 | letter, return_counts=True)
        marks = np.zeros(len(self.words), np.uint64)
        for times in range(3):
            k = kind[n > times]
            bit = ((k & 255) * 37 + times * 23 & 63).astype(np.uint64)
            np.bitwise_or.at(marks, k >> 8, np.uint64(1) << bit)
        return marks

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        trie = Trie(self.vectors[self.own], np.ones(len(self.own), np.int64), LEAF_WORDS)
        for lo, hi, who, state in trie.search(self.vectors):
            leaf = self.own[lo:hi]
            # own words that nothing told apart so far are both in the leaf and meet both ways
            inside = (state == SAME) & self.home[who]
            if len(leaf) * len(who) > LEAF_PAIRS:
                yield self.by_rest(leaf, who, inside)
                continue
            apart = np.bitwise_count(self.marks[who][:, None] ^ self.marks[leaf][None, :]) <= 2
            longer = self.lengths[leaf][None, :] - self.lengths[who][:, None]
            apart &= (np.abs(longer) <= 1) & (~inside[:, None] | (who[:, None] < leaf[None, :]))
            i, j = np.nonzero(apart)
            if len(i):
                yield self.verified(who[i], leaf[j])

    def verified(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = np.maximum(self.lengths[u], self.lengths[v]) > SHORT
        right = np.zeros(len(u), bool)
        for k in np.flatnonzero(long).tolist():
            right[k] = one_edit(self.words[u[k]], self.words[v[k]])
        rest = np.flatnonzero(~long)
        short = np.where(self.lengths[u[rest]] <= self.lengths[v[rest]], u[rest], v[rest])
        a, b = self.matrix[short], self.matrix[u[rest] + v[rest] - short]
        differs = a != b
        first = differs.argmax(axis=1)
        shifted = a[:, :-1] != b[:, 1:]
        shifted &= np.arange(SHORT) >= first[:, None]
        equal = self.lengths[u[rest]] == self.lengths[v[rest]]
        right[rest] = np.where(equal, differs.sum(axis=1) == 1, ~shifted.any(axis=1))
        return u[right], v[right]

    def by_rest(self, leaf: np.ndarray, who: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same links by the rest of each word after a letter is taken out."""
        rests, wholes = defaultdict(list), defaultdict(list)
        for j in leaf.tolist():
            w = self.words[j]
            for i in range(len(w)):
                rests[i, w[:i] + w[i + 1:]].append(j)
                if not i or w[i] != w[i - 1]:
                    wholes[w[:i] + w[i + 1:]].append(j)
        found = []
        for k, one_way in zip(who.tolist(), inside.tolist(), strict=True):
            w = self.words[k]
            same = {j for i in range(len(w)) for j in rests.get((i, w[:i] + w[i + 1:]), ())}
            found += [(k, j) for j in same if not one_way or k < j]
            found += [(k, j) for j in wholes.get(w, ())]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def cell_links(table: pa.Table) -> pa.Table:
    words, n = table["word"].combine_chunks(), table["n"].combine_chunks()
    found = list(Cell(latin(words), table["home"].to_numpy()).links())
    u = pa.array(np.concatenate([x for x, _ in found] + [np.zeros(0, np.int64)]))
    v = pa.array(np.concatenate([x for _, x in found] + [np.zeros(0, np.int64)]))
    # either word has the other one as a partner
    here, there = pa.chunked_array([u, v]), pa.chunked_array([v, u])
    return pa.table({"word": words.take(here), "n": n.take(here),
                     "near": words.take(there), "near_n": n.take(there)})


def links(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """`word`, `n`, `near`, `near_n` for every two words of `words` (`word`, `n`) one edit apart,
    in both directions."""
    words = stage(words.mapInArrow(with_vectors, "word string, n long, vector binary"), "word-vectors")
    top = planned(words, cell_words)
    one = chunks.tidy(cell_links)
    return words.mapInArrow(lambda it: routed(it, top), ROUTED) \
        .groupBy("cell").applyInArrow(lambda table: one(table), LINK)


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """`word`, `root`: the last form along a chain of at most `steps`."""
    ends = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        ends = stage(ends, "form-ends")
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = ends.join(onward, "root", "left") \
            .select("word", F.coalesce("next", "root").alias("root"))
        reach *= 2
    return ends


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text",
             cell_words: int = CELL_WORDS) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of each word of `docs`."""
    words = stage(word_counts(docs, id, text), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    partners = links(words, cell_words).groupBy("word", "n") \
        .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.n") >= TIMES * F.col("n")
    found = stage(partners.select(
        "word", "n_near", F.when(often, F.col("best.near")).alias("form"),
        F.when(often, -F.col("best.n")).alias("form_n")), "word-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = len(str(most)) - 1
    ends = roots(found.where("form IS NOT NULL").select("word", "form"), steps)
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

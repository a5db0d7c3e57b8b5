"""Stupid-backoff language-model scores under counts over the whole corpus.

Count tables of word n-grams are partitioned by hash bucket; each chunk of documents holds its
exploded n-grams and joins them to the buckets' totals through `chunks`, both sides packed: a chunk
asks with its distinct hashes and their own counts, a bucket adds up and answers. Unigrams and bigrams
come first; a trigram is asked for only if both its bigrams are frequent enough for it to be. The
scores are then summed per document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.llm.chunks import Chunk
from postlens.llm.substring_dedup import BASES, rolling, word_hashes

BACKOFF = 0.4
WORD = "[^\\x20\\x09-\\x0D]+"
#: N-grams of two or three words that occur less often are not in the model.
LEAST_COUNT = 2
FOUND = "key long, text string, rest {rest}, n_tokens long, n_trigrams long, n_bigrams long, " \
    "n_unigrams long, log_sum double"


class Grams:
    """The n-grams of a chunk; at each word: does a bigram, a trigram end here in its document."""

    def __init__(self, c: Chunk):
        words, self.counts = word_hashes(c)
        n = len(words)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        place = np.arange(n) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        self.one = chunks.mix(words ^ BASES[1])
        self.two = rolling(words, 2, BASES[0]) if n > 1 else words[:0]
        self.three = rolling(words, 3, BASES[0]) if n > 2 else words[:0]
        # The bigram that ends at word i is two[i - 1], the trigram three[i - 2].
        asked = np.concatenate([self.one, self.two[self.second - 1]])
        self.keys, group, own = np.unique(asked, return_inverse=True, return_counts=True)
        self.own = own.astype(np.uint64)
        self.one_at, self.two_at = group[:n], np.zeros(n, np.int64)
        self.two_at[self.second] = group[n:]

    def learn(self, totals: np.ndarray) -> None:
        """Totals of words and bigrams; then which trigrams can be frequent enough."""
        self.c1 = totals[self.one_at]
        self.c2 = np.zeros(len(self.one_at), np.uint64)
        self.c2[self.second] = totals[self.two_at[self.second]]
        i = self.third
        self.maybe = i[np.minimum(self.c2[i], self.c2[i - 1]) >= LEAST_COUNT]
        self.keys, self.three_at, own = np.unique(self.three[self.maybe - 2], return_inverse=True,
                                                  return_counts=True)
        self.own = own.astype(np.uint64)

    def scores(self, totals: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words scored by each order, and the sum of logs but for the corpus size, by document."""
        c3 = np.zeros(len(self.c1), np.uint64)
        c3[self.maybe] = totals[self.three_at]
        by3 = c3 >= LEAST_COUNT
        by2 = ~by3 & (self.c2 >= LEAST_COUNT)
        by1 = ~by3 & ~by2
        log = np.log10(np.where(by3, c3, np.where(by2, self.c2, self.c1)).astype(float))
        i = np.flatnonzero(by3)
        log[i] -= np.log10(self.c2[i - 1].astype(float))
        i = np.flatnonzero(by2)
        log[i] -= np.log10(self.c1[i - 1].astype(float))
        place = np.zeros(len(log), np.int64)
        place[self.second], place[self.third] = 1, 2
        order = np.where(by3, 2, np.where(by2, 1, 0))
        log += (place - order) * np.log10(BACKOFF)
        sums = [np.bincount(self.doc, w, len(self.counts)) for w in (by3, by2, by1, log)]
        return (*(s.astype(np.int64) for s in sums[:3]), sums[3].astype(float))


def totals(phase: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Bucket task: the total count of each key that was asked for."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = chunks.ordered(table)
        each = [chunks.unpack_sorted(x.as_py()) for x in table["keys"]]
        own = np.concatenate([chunks.unpack(x.as_py(), "<u8") for x in table["more"]])
        keys, group = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, group, own)
        return chunks.answer(phase, key[0].as_py(), table["chunk"].to_pylist(),
                             [len(x) for x in each], total[group], chunks.pack)

    return run


def counts(said: pa.Table, phase: int) -> np.ndarray:
    got = [chunks.unpack(r, "<u8") for _, r in chunks.replies(said, phase)]
    return np.concatenate(got) if got else np.zeros(0, np.uint64)


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text",
           chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """`docs` with `n_tokens`, `n_trigrams`, `n_bigrams`, `n_unigrams` (words by the order that
    scored them), `log10_score` (sum over the words) and `mean_log10` (null without words).

    A word `[^\\x20\\x09-\\x0D]+` scores c(abc) / c(ab) if abc occurs at least `LEAST_COUNT` times,
    else 0.4 * c(bc) / c(b) under the same condition, else 0.4 * 0.4 * c(c) / N; at the start of a
    document with fewer orders to back off from. Counts run over all documents, copies included.
    Null and empty texts have no words and a score of 0. Columns so named are replaced. An empty
    table gives an empty one. Rows of equal id are documents of their own.
    """
    sizes = chunks.measure(docs, text, chunk_bytes)
    buckets = chunks.parts(sizes.text_bytes / 4)
    df = chunks.dealt(docs, sizes.chunks, id, text)
    found = FOUND.format(rest=df.schema["rest"].dataType.simpleString())

    def first(chunk: int, c: Chunk) -> pa.Table:
        g = Grams(c)
        return chunks.ask(chunk, buckets, 64, g.keys, g.own)

    def second(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        g = Grams(c)
        g.learn(counts(said, 1))
        return chunks.ask(chunk, buckets, 64, g.keys, g.own)

    def score(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        g = Grams(c)
        g.learn(counts(said, 1))
        by3, by2, by1, log = g.scores(counts(said, 2))
        return pa.table({
            "key": c.table["key"], "text": c.table["text"], "rest": c.table["rest"],
            "n_tokens": pa.array(g.counts, pa.int64()), "n_trigrams": pa.array(by3),
            "n_bigrams": pa.array(by2), "n_unigrams": pa.array(by1), "log_sum": pa.array(log)})

    low = chunks.by_bucket(chunks.by_chunk(df, first, chunks.ASK), totals(1))
    high = chunks.by_bucket(chunks.with_replies(df, [low], second, chunks.ASK), totals(2))
    out = chunks.with_replies(df, [low, high], score, found)
    words = F.regexp_count(F.col(text), F.lit(WORD))
    size = docs.agg(F.sum(words)).first()[0] or 1
    total = F.col("log_sum") - F.col("n_unigrams") * F.log10(F.lit(float(size)))
    out = out.withColumn("log10_score", total) \
        .withColumn("mean_log10", F.try_divide(total, F.col("n_tokens")))
    return chunks.returned(out, docs, text, ["n_tokens", "n_trigrams", "n_bigrams", "n_unigrams",
                                             "log10_score", "mean_log10"])

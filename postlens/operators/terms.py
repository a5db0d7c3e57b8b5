"""Term features: words and word pairs, pruned vocabulary, smoothed and normalised TF-IDF.

Two forms with the same numbers. The table form gives one (doc, term, weight) row per non-zero
cell, the vector form MLlib vectors for the clustering jobs. Terms are counted inside the row they
occur in, a few MB of text at a time, so no shuffle carries tokens: the vocabulary shuffles one partial
row per term and task, and the weights nothing.

The column of words is an array, or a string with a space between two words, which costs a fraction of
the array wherever it is written, read or passed to Python.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import stage

# Feature settings.
MAX_TERMS = 500
MIN_DOCS = 3
MAX_SHARE = 0.7

# Bits of the constant by which tasks know frequent words. Its size does not follow the corpus: two
# words of one bit only let a few more pairs be counted.
WORD_BITS = 1 << 18
# Bytes of words counted at once.
SLICE_BYTES = 8 << 20


def english_stop_words() -> list[str]:
    """MLlib's own list; every caller can pass another."""
    return StopWordsRemover.loadDefaultStopWords("english")


def corpus_text(title: Column, skills: Column, description: Column) -> Column:
    """Title twice for weight, then skills, then description."""
    return F.concat_ws(" ", title, title, F.array_join(skills, " "), description)


def with_words(df: DataFrame, text: Column, stop_words: Sequence[str] | None = None,
               out: str = "words") -> DataFrame:
    """Add the array of lower-case words of two or more word characters, stop words left out."""
    stops = english_stop_words() if stop_words is None else list(stop_words)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return df.withColumn(out, F.filter(words, lambda w: ~w.isin(stops)) if stops else words)


def with_word_line(df: DataFrame, text: Column, stop_words: Sequence[str] | None = None,
                   out: str = "words") -> DataFrame:
    """As `with_words`, the words in one string with a space between them; null for a null text."""
    stops = pa.array(english_stop_words() if stop_words is None else list(stop_words), pa.string())

    @F.arrow_udf("string")
    def line(texts: pa.Array) -> pa.Array:
        done = [pa.array([], pa.string())]
        for part in _slices(texts):
            found = pc.split_pattern(pc.replace_substring_regex(part, r"[^\pL\pN_]+", " "), " ")
            sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            words = found.flatten()
            kept = pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, stops)))
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(part)), sizes), minlength=len(part),
                                         weights=kept.to_numpy(zero_copy_only=False)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words.filter(kept))
            lines = pc.binary_join(lists, " ")
            done.append(pc.if_else(part.is_valid(), lines, pa.scalar(None, pa.string())))
        return pa.concat_arrays(done)

    return df.withColumn(out, line(F.lower(text)))


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of a column of about `SLICE_BYTES`, a row at least."""
    if not len(column):
        return
    if pa.types.is_list(column.type):  # some 8 bytes a word
        sizes = pc.multiply(pc.list_value_length(column), 8)
    else:
        sizes = pc.binary_length(column)
    total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.append(np.flatnonzero(np.diff(total // SLICE_BYTES)) + 1, len(column))
    at = 0
    for end in ends.tolist():
        yield column.slice(at, end - at)
        at = end


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of each word, its number among the different words (-1: null), and these."""
    lists = column if pa.types.is_list(column.type) else pc.split_pattern(column, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows, words = np.repeat(np.arange(len(column)), sizes), lists.flatten()
    if lists is not column:  # an empty line splits into one empty word
        there = pc.not_equal(words, "")
        rows, words = rows[there.to_numpy(zero_copy_only=False)], words.filter(there)
    coded = words.dictionary_encode()
    return rows, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows each of n terms occurs, and how often."""
    keys, tf = np.unique(rows * n + ids, return_counts=True)
    ids = keys % n
    return np.bincount(ids, minlength=n), np.bincount(ids, weights=tf, minlength=n).astype(np.int64)


def _single_counts(column: pa.Array) -> pa.RecordBatch:
    rows, ids, words = _coded(column)
    there = ids >= 0
    df, cf = _counted(rows[there], ids[there], max(len(words), 1))
    return pa.RecordBatch.from_arrays(
        [words, pa.array(df[:len(words)]), pa.array(cf[:len(words)])], names=["term", "df", "cf"])


def _pair_counts(column: pa.Array, marked: np.ndarray | None) -> pa.RecordBatch:
    """Pairs of marked words, or all."""
    rows, ids, words = _coded(column)
    used = np.ones(len(words) + 1, bool)
    if marked is not None:
        used[:-1] = marked[[zlib.crc32(w) % len(marked) for w in words.cast(pa.binary()).to_pylist()]]
    used[-1] = False  # null words have number -1
    good = used[ids]
    at = np.flatnonzero((rows[1:] == rows[:-1]) & good[1:] & good[:-1])
    pairs, own = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True)
    first, second = (words.take(pa.array(x, pa.int64())) for x in np.divmod(pairs, max(len(words), 1)))
    df, cf = _counted(rows[at], own, max(len(pairs), 1))
    return pa.RecordBatch.from_arrays(
        [pc.binary_join_element_wise(first, second, " "), pa.array(df[:len(pairs)]), pa.array(cf[:len(pairs)])],
        names=["term", "df", "cf"])


def word_pairs(words: Column) -> Column:
    """Adjacent words joined by a space. A null word makes no pair."""
    return F.array_compact(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)),
                                      lambda a, b: F.concat(a, F.lit(" "), b)))


def all_terms(words: Column) -> Column:
    """Words, then pairs. Stop words are gone already, so a pair may span one."""
    return F.concat(words, word_pairs(words))


def term_counts(df: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, term, tf), counted within the row: sort its terms, then measure the runs."""
    at = F.col("_sorted")
    begins = F.filter(
        F.transform(at, lambda t, i: F.when((i == 0) | (F.get(at, i - 1) != t), i)),
        lambda i: i.isNotNull())
    ends = F.concat(F.slice("_begins", 2, F.size("_begins")), F.array(F.size(at)))
    runs = F.zip_with(F.col("_begins"), ends,
                      lambda a, b: F.struct(F.get(at, a).alias("term"), (b - a).alias("tf")))
    return (
        df.select(F.col(doc), F.sort_array(terms).alias("_sorted"))
        .withColumn("_begins", begins)
        .select(doc, F.inline_outer(runs)).filter(F.col("term").isNotNull())
        .select(doc, "term", F.col("tf").cast("bigint").alias("tf"))
    )


def vocabulary(df: DataFrame, doc: str, n_docs: int, words: str = "words",
               max_terms: int = MAX_TERMS, min_docs: int = MIN_DOCS,
               max_share: float = MAX_SHARE) -> DataFrame:
    """(term, df, cf): terms in neither too few nor too many documents, then the most frequent.

    Words are counted first. A pair occurs no more often than either of its words, so once enough
    words qualify, only pairs of words at least as frequent as the last of them can enter, and no
    others are counted. That replaces the many rare pairs, which make up most of the distinct terms
    of a corpus, by at most a few hundred thousand.
    """
    def fitting(counts: DataFrame) -> DataFrame:
        return counts.filter((F.col("df") >= min_docs) & (F.col("df") <= n_docs * max_share))

    def most_frequent(counts: DataFrame) -> DataFrame:
        return fitting(counts).orderBy(F.desc("cf"), "term").limit(max_terms)

    singles = stage(_totals(df, words, _single_counts), "words")
    found, least = most_frequent(singles).agg(F.count("*"), F.min("cf")).first()
    marked = None
    if found == max_terms:
        marked = bit_set(singles.filter(F.col("cf") >= least).select(word_bit("term").alias("b")))
    return most_frequent(singles.unionByName(
        _totals(df, words, lambda column: _pair_counts(column, marked))))


def word_bit(word: Column | str) -> Column:
    return F.pmod(F.crc32(word), F.lit(WORD_BITS)).cast("int")


def bit_set(bits: DataFrame) -> np.ndarray:
    """Which of the bits are among `b`; at most `WORD_BITS` come here."""
    marked = np.zeros(WORD_BITS, bool)
    marked[[b for (b,) in bits.distinct().collect()]] = True
    return marked


def _totals(df: DataFrame, words: str, counts: Callable[[pa.Array], pa.RecordBatch]) -> DataFrame:
    """(term, df, cf) over all rows."""
    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in _slices(batch.column(0)):
                yield counts(part)

    return df.select(words).mapInArrow(counted, "term string, df long, cf long") \
        .groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def tfidf(df: DataFrame, doc: str, words: str = "words", max_terms: int = MAX_TERMS,
          min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(doc, term, tf, weight): tf * (ln((1+n)/(1+df)) + 1), each document scaled to length 1."""
    df = stage(df.select(doc, words), "words")
    model = fit_terms(df, doc, words, max_terms, min_docs, max_share)
    names = F.split(F.lit("|".join(model.vocabulary)), r"\|")
    tf, weight = vector_to_array(F.col("_tf")), vector_to_array(F.col("_weight"))
    cells = F.filter(F.arrays_zip(names.alias("term"), F.col("_t").alias("tf"),
                                  F.col("_w").alias("weight")), lambda c: c["tf"] > 0)
    # Counts, weights and norm all come from the row itself, so nothing is shuffled.
    return (
        model.transform(df, words, "_weight", counts="_tf")
        .select(doc, tf.alias("_t"), weight.alias("_w"))
        .select(doc, F.inline(cells).alias("term", "tf", "weight"))
        .withColumn("tf", F.col("tf").cast("bigint"))
    )


@dataclass
class TermModel:
    """Fitted vocabulary and weights. `transform` is a narrow pass."""

    vocabulary: list[str]
    weights: np.ndarray

    def transform(self, df: DataFrame, words: str = "words", out: str = "features",
                  counts: str | None = None) -> DataFrame:
        """Add the weights as vector `out`, and if named the counts. A null gives an empty vector."""
        done = df.withColumn(out, self._vectors(weighted=True)(F.col(words)))
        return done.withColumn(counts, self._vectors(weighted=False)(F.col(words))) if counts else done

    def _vectors(self, weighted: bool) -> Callable[[Column], Column]:
        n, weights, singles = len(self.vocabulary), self.weights, pa.array(self.vocabulary, pa.string())
        # the two words of a pair, wherever a term can be parted
        parted = [(t[:i], t[i + 1:], v) for v, t in enumerate(self.vocabulary) for i, c in enumerate(t) if c == " "]
        parts = pa.array(sorted({w for a, b, _ in parted for w in (a, b)}), pa.string())
        number = {w: i for i, w in enumerate(parts.to_pylist())}
        pairs = sorted((number[a] * len(parts) + number[b], v) for a, b, v in parted)
        pair_keys, pair_terms = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))

        def looked_up(words: pa.Array, among: pa.Array) -> np.ndarray:
            """Places of the words, -1 for others and for null words, whose number is -1."""
            at = pc.fill_null(pc.index_in(words, among), -1).to_numpy(zero_copy_only=False)
            return np.append(at, -1).astype(np.int64)

        def cells(column: pa.Array) -> pa.Array:
            rows, ids, words = _coded(column)
            own, part = looked_up(words, singles)[ids], looked_up(words, parts)[ids]
            found = np.flatnonzero(own >= 0)
            keys = [rows[found] * n + own[found]]
            at = np.flatnonzero((rows[1:] == rows[:-1]) & (part[1:] >= 0) & (part[:-1] >= 0)) if pairs else []
            if len(at):
                key = part[at] * len(parts) + part[at + 1]
                place = np.minimum(np.searchsorted(pair_keys, key), len(pair_keys) - 1)
                hit = pair_keys[place] == key
                keys.append(rows[at[hit]] * n + pair_terms[place[hit]])
            keys, tf = np.unique(np.concatenate(keys), return_counts=True)
            row, term = np.divmod(keys, n)
            values = tf.astype(float)
            if weighted:
                values *= weights[term]
                values /= np.sqrt(np.bincount(row, weights=values * values, minlength=len(column)))[row]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(column)))), pa.int32())
            return pa.StructArray.from_arrays(
                [pa.array(np.zeros(len(column), np.int8)), pa.array(np.full(len(column), n, np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(values))],
                names=["type", "size", "indices", "values"])

        @F.arrow_udf(VectorUDT())
        def vectors(column: pa.Array) -> pa.Array:
            return pa.concat_arrays([cells(part) for part in _slices(column)] or [cells(column)])

        return vectors


def fit_terms(df: DataFrame, doc: str, words: str = "words", max_terms: int = MAX_TERMS,
              min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> TermModel:
    """Fit vocabulary and weights. At most `max_terms` rows come to the driver.

    MLlib's IDF lacks the trailing +1 and its CountVectorizer settles ties by chance, so neither is used.
    If no term is kept, the one empty term marks nothing.
    """
    n_docs = df.count()
    rows = vocabulary(df, doc, n_docs, words, max_terms, min_docs, max_share).collect()
    df_of = {r["term"]: r["df"] for r in rows} or {"": n_docs}
    weights = np.log((1 + n_docs) / (1 + np.array(list(df_of.values())))) + 1
    return TermModel(list(df_of), weights)

"""Repeated word windows, found by Rabin-Karp hashes that are counted in Spark.

Every window of `width` consecutive words gets a polynomial hash. A first count over 40 of its bits
tells which windows can recur at all; only those are counted by the whole hash (64 bits and 16 more
from a second polynomial), with the smallest id that has them. A word goes if a window over it also
starts in a document with a smaller id. Both counts go through `chunks`: a chunk sends each distinct
hash once, so neither a common window nor a large group of copies makes a hot task.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm import chunks
from postlens.llm.chunks import Chunk

WIDTH = 13
FILTER_BITS = 40
BASES = (np.uint64(0x9E6C63D0876A9A47), np.uint64(0xD1342543DE82EF95))
#: Longer words are hashed one by one.
LONG_WORD = 256
FOUND = "key long, text string, rest {rest}, n_words long, n_removed long, " \
    "removed array<struct<begin:long,end:long>>"


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of `[^\\x20\\x09-\\x0D]+`, and the number of words per document."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = np.zeros(chunk.size + 1, bool)
    inside[:-1] = ~space[chunk.bytes[:chunk.size]]
    begins, ends = chunks.runs(inside[:-1], chunk.starts)
    length = ends - begins
    h = length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    live, offset = np.flatnonzero(length <= LONG_WORD), 0
    while len(live):
        left = length[live] - offset
        x = chunk.words(begins[live], offset)
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = chunks.mix(h[live] ^ x)
        offset += 8
        live = live[left > 8]
    if (length > LONG_WORD).any():
        import xxhash

        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(chunk.bytes[begins[i]:ends[i]].tobytes())
    counts = np.searchsorted(begins, chunk.ends) - np.searchsorted(begins, chunk.starts)
    return h, counts


def rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each `width` neighbours."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for i in range(1, width):
        out *= base
        out += h[i:i + n]
    return chunks.mix(out)


class Windows:
    """All windows of a chunk: place of the first word, document, hash."""

    def __init__(self, chunk: Chunk, width: int):
        self.hashes, self.counts = word_hashes(chunk)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        n = max(0, len(self.hashes) - width + 1)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)[:n]
        fits = np.arange(n) + width <= self.ends[doc]
        self.at = np.flatnonzero(fits)
        self.key = chunk.keys[doc[self.at]]
        self.hash = rolling(self.hashes, width, BASES[0])[self.at] if n else np.zeros(0, np.uint64)
        self.low = self.hash >> np.uint64(64 - FILTER_BITS)

    def check(self, width: int, chosen: np.ndarray) -> np.ndarray:
        """16 more hash bits of the chosen windows."""
        if not len(chosen):
            return np.zeros(0, np.uint32)
        second = rolling(self.hashes, width, BASES[1])[self.at[chosen]]
        return (second >> np.uint64(48)).astype(np.uint32)


def possible(w: Windows, shared: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct filter keys; and, with the replies to them, the windows that can recur."""
    low, group = np.unique(w.low, return_inverse=True)
    if shared is None:
        return low, group
    least, most = chunks.first_and_last(group, w.key, len(low))
    return low, np.flatnonzero((shared | (least != most))[group])


class Entries:
    """The distinct windows among the chosen ones, by hash: what a chunk asks about."""

    def __init__(self, w: Windows, width: int, chosen: np.ndarray):
        check = w.check(width, chosen)
        hashes, keys = w.hash[chosen], w.key[chosen]
        order = np.lexsort((keys, check, hashes))
        h, c = hashes[order], check[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[:len(h)]
        self.group = np.empty(len(h), np.int64)
        self.group[order] = np.cumsum(first) - 1
        self.hash, self.check, self.key = h[first], c[first], keys[order][first]

    def gone(self, w: Windows, chosen: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """First words of the windows that a smaller id has as well."""
        here = smaller[self.group] | (w.key[chosen] > self.key[self.group])
        return w.at[chosen[here]]


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH,
          chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Returns the rows of `docs` with `text` replaced by the kept words joined by one space, and
    `n_words`, `n_removed` and `removed` (word intervals); columns so named are replaced, all others
    kept. Null texts count as empty. A null id is after every other; rows of equal id are one
    document, in which nothing repeats. An empty table gives an empty one.
    """
    sizes = chunks.measure(docs, text, chunk_bytes)
    buckets = chunks.parts(sizes.text_bytes / 6)
    df = chunks.dealt(docs, sizes.chunks, id, text)
    found = FOUND.format(rest=df.schema["rest"].dataType.simpleString())

    def count(chunk: int, c: Chunk) -> pa.Table:
        return chunks.ask(chunk, buckets, FILTER_BITS, possible(Windows(c, width), None)[0])

    def compare(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        w = Windows(c, width)
        _, chosen = possible(w, chunks.reply_bits(said, 1))
        e = Entries(w, width, chosen)
        return chunks.ask(chunk, buckets, 64, e.hash, e.check, e.key)

    def remove(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        w = Windows(c, width)
        _, chosen = possible(w, chunks.reply_bits(said, 1))
        at = Entries(w, width, chosen).gone(w, chosen, chunks.reply_bits(said, 2))
        gone = chunks.covered(len(w.hashes), at, at + width)
        return kept(c, w, gone)

    filtered = chunks.by_bucket(chunks.by_chunk(df, count, chunks.ASK), chunks.recurring(1))
    decided = chunks.by_bucket(chunks.with_replies(df, [filtered], compare, chunks.ASK),
                               chunks.earlier(2))
    out = chunks.with_replies(df, [filtered, decided], remove, found)
    return chunks.returned(out, docs, text, ["n_words", "n_removed", "removed"])


def kept(c: Chunk, w: Windows, gone: np.ndarray) -> pa.Table:
    begins, ends = chunks.runs(gone, w.starts)
    spans = np.searchsorted(begins, w.starts), np.searchsorted(begins, w.ends)
    texts, removed, lost = [], [], []
    for d, t in enumerate(c.texts):
        words, i, j = t.split(), spans[0][d], spans[1][d]
        here = gone[w.starts[d]:w.ends[d]]
        n = int(here.sum())
        texts.append(b" ".join(compress(words, ~here) if n else words))
        lost.append(n)
        removed.append([{"begin": int(b - w.starts[d]), "end": int(e - w.starts[d])}
                        for b, e in zip(begins[i:j], ends[i:j], strict=True)] if n else [])
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "key": c.table["key"], "text": pa.array(texts, pa.binary()).cast(pa.string()),
        "rest": c.table["rest"], "n_words": pa.array(w.counts, pa.int64()),
        "n_removed": pa.array(lost, pa.int64()), "removed": pa.array(removed, span)})

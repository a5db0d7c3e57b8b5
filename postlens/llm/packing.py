"""Best-fit packing of token sequences, planned over a histogram of lengths.

Texts are tokenized once, into pieces of at most `size` tokens. What is planned is not the pieces but
their lengths: at most `size` counts, whatever the number of documents. Best fit decreasing over the
counts gives, for each length, a list of slots: so many sequences from this number on, at this
offset. Pieces are numbered within their length (counted by group, never in one task) and take the
slot that their number falls in.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.session import stage

SIZE = 4096
END = 1
#: Groups into which the pieces of a length are dealt to be numbered, at least, and their pieces.
GROUPS, GROUP_PIECES = 256, 1_000_000
#: Word pieces whose ids a worker remembers; then it starts afresh.
REMEMBERED = 250_000

PIECES = "key long, text_hash long, piece int, start long, length long, ids_crc32 long"

#: Letters and numbers below U+0180, where every text is in composed form and small letters stay in range.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SIMPLE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|"
                    f"[{LETTERS}]+|[{NUMBERS}]|[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+")
#: Texts with these go to the tokenizer whole: other scripts, İ, control spaces, special tokens.
OTHER = re.compile("[^\x00-\u017f]|[İ\x1c-\x1f]|<\\|")


class WordCache(dict):
    """Number of each word piece; its ids are `flat[at[i]:at[i + 1]]`. Looking up an unknown piece
    gives it the next number; the ids of all new ones are then learnt in bulk. Pieces are already in
    the form that the tokenizer's own first steps give, so only its byte form and merges are left to
    do, and it marks the last id of each piece, so one call over many can be cut."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n

    def learn(self) -> None:
        lines = [" ".join(self.new[i:i + 64]) for i in range(0, len(self.new), 64)]
        got = self.merger.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for x in got for i in x.ids], np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(self.new):
            raise ValueError("word pieces and their last ids differ in number")
        self.at = np.concatenate([self.at, ends + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > REMEMBERED:
            self.forget()
        pieces = [None if OTHER.search(t) else SIMPLE.findall(t.lower()) for t in texts]
        numbers = [None if p is None else np.fromiter(map(self.__getitem__, p), np.int64, len(p))
                   for p in pieces]
        if self.new:
            self.learn()
        out = []
        for t, i in zip(texts, numbers, strict=True):
            if i is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids,
                                    np.uint32))
                continue
            begin, n = self.at[i], self.at[i + 1] - self.at[i]
            before = np.cumsum(n) - n
            out.append(self.flat[np.arange(int(n.sum())) + np.repeat(begin - before, n)])
        return out


@lru_cache(maxsize=2)
def cache(path: str) -> WordCache:
    """One per worker process."""
    return WordCache(path)


def encoded(it: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Tables of rows with the ids of their texts, the end id included."""
    words = cache(path)
    for batch in it:
        for i in range(0, len(batch), 512):
            table = pa.Table.from_batches([batch.slice(i, 512)])
            texts = [t or "" for t in table["text"].to_pylist()]
            yield table, [np.append(x, np.uint32(END)) for x in words.encode(texts)]
    chunks.give_back()


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
           size: int = SIZE) -> DataFrame:
    """`PIECES` of each document. `text_hash` tells apart rows of equal id."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in encoded(it, tokenizer):
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(rows):
                for p, s in enumerate(range(0, len(ids), size)):
                    part = ids[s:s + size]
                    row.append(r)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [table["key"].combine_chunks().take(row),
                 table["text_hash"].combine_chunks().take(row), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["key", "text_hash", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id].cast("long").alias("key"), docs[text].alias("text"),
                       F.xxhash64(docs[text]).alias("text_hash")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first number, end number, first sequence, offset) by best fit decreasing.

    Open sequences are kept as groups (space left, first sequence, how many), so the work depends on
    how many lengths there are, not on how many pieces. The longest pieces go first, each into the
    fullest group that has room; several of one length fill a sequence in one step.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_groups: list[tuple[int, int, int]] = []
    sequence = 0
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            i = bisect_left(open_groups, (length,))
            if i == len(open_groups):
                each = size // length
                n = max(1, left // each)
                open_groups.append((size, sequence, n))
                sequence += n
                continue
            space, first, n = open_groups.pop(i)
            deep = max(1, min(space // length, left // n))
            n_used = min(n, left)
            for k in range(deep):
                slots.append((length, number, number + n_used, first, size - space + k * length))
                number += n_used
                left -= n_used
            if space > deep * length:
                insort(open_groups, (space - deep * length, first, n_used))
            if n > n_used:
                insort(open_groups, (space, first + n_used, n - n_used))
    return slots


def numbered(found: DataFrame, rows: int) -> DataFrame:
    """`rank` of each piece within its length. Pieces are dealt into groups, the groups counted, and
    only inside a group, a bounded share of its length, are pieces put in order."""
    dealt = found.withColumn("group", F.pmod(F.xxhash64("key", "text_hash", "piece"),
                                             F.lit(max(GROUPS, rows // GROUP_PIECES))).cast("int"))
    counts = dealt.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = stage(counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n"))
        .drop("n"), "ranks")
    inside = Window.partitionBy("length", "group").orderBy("key", "text_hash", "piece")
    return dealt.withColumn("number", F.row_number().over(inside) - 1) \
        .join(before, ["length", "group"]) \
        .withColumn("rank", F.col("before") + F.col("number")).drop("before", "number", "group")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
         size: int = SIZE) -> DataFrame:
    """One row per piece: `id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset`.

    A document is its ids and the end id, so a null or empty text is one piece of length 1. Only
    longer ones than `size` are cut. Rows of equal id are packed each on its own; equal rows are
    interchangeable. A null id stays null. An empty table gives an empty one.
    """
    found = stage(pieces(docs, tokenizer, id, text, size), "pieces")
    # At most `size` rows.
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    by_length: dict[int, list[tuple]] = {}
    for length, *slot in plan(counts, size):
        by_length.setdefault(length, []).append(tuple(slot))
    slots = found.sparkSession.createDataFrame(
        [(k, [s[0] for s in v], v) for k, v in by_length.items()],
        "length long, begins array<long>, "
        "slots array<struct<begin:long,end:long,sequence:long,offset:long>>")
    # The plan has one row per length, so it is small enough to send to all.
    placed = numbered(found, sum(counts.values())).join(F.broadcast(slots), "length") \
        .withColumn("slot", F.expr("filter(slots, s -> s.begin <= rank AND rank < s.end)[0]"))
    return placed.select(
        F.col("key").alias(id), "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.col("rank") - F.col("slot.begin")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"))


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, id: str = "doc_id",
              text: str = "text", size: int = SIZE) -> DataFrame:
    """The packed sequences themselves: `sequence_id`, `ids` in order of offset. Ids must be unique
    here, as pieces meet their tokens by id."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in encoded(it, tokenizer):
            row, piece, ids = [], [], []
            for r, x in enumerate(rows):
                for p, s in enumerate(range(0, len(x), size)):
                    row.append(r)
                    piece.append(p)
                    ids.append(x[s:s + size].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [table["key"].combine_chunks().take(pa.array(row, pa.int64())),
                 pa.array(piece, pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                names=["key", "piece", "ids"])

    tokens = docs.select(docs[id].cast("long").alias("key"), docs[text].alias("text")) \
        .mapInArrow(cut, "key long, piece int, ids array<int>")
    return packed.withColumnRenamed(id, "key").join(tokens, ["key", "piece"]) \
        .groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids")))
                                    .alias("parts")) \
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))

"""Repeated byte strings, by a distributed merge sort of suffixes that keeps track of common prefixes.

A byte goes if a `width`-byte string over it also starts in a document with a smaller id. Sorting a
suffix at every byte would move many times the text, so the sort is narrowed in two steps that lose
nothing:

* Each `width`-byte window picks its smallest 20-gram hash as anchor; equal windows pick equal ones.
  Neighbouring windows of one anchor form a span, about one for each 16 bytes. Spans whose anchor no
  other document has cannot repeat.
* The remaining spans are sorted as whole strings. One that a smaller id has too is settled, with all
  of its windows. The windows of the others (the edges of repeats, and first copies) are sorted one
  by one, those only whose hash another document has.

Both sorts are the same merge sort. A chunk of documents sorts its distinct suffixes (cut at the
length that matters) into a run, cuts the run at splitters taken from a sample of the text, and sends
each part front-coded: length of the prefix shared with the one before, and the rest. The task of a
range merges the runs with a loser tree, whose nodes hold how far each loser agrees with the last
output: a comparison looks at bytes only if two agree equally far, and then only remembers where they
part, so that no known prefix is compared again. Equal neighbours in the merged order are the
repeats.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.llm.chunks import Chunk

WIDTH = 50
ANCHOR = 20
FILTER_BITS = 40
#: Most strings that are sampled from the text to place the splitters; they alone go to the driver.
SAMPLE = 20_000
#: Bytes of text for each range of the merge.
RANGE_BYTES = 8 << 20
BLOCK = 1 << 17

RUN = "range int, chunk int, n long, prefixes binary, lengths binary, tails binary, ids binary, " \
    "slots binary"
FOUND = "key long, text binary, rest {rest}, n_bytes long, n_removed long, " \
    "removed array<struct<begin:long,end:long>>, kept_sha256 string"

u64 = np.uint64


# --- anchors ------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, begin: int, n: int) -> np.ndarray:
    """Hashes of the 20-byte strings at `begin` and the n - 1 next places."""
    def load(offset: int, kind: str) -> np.ndarray:
        return np.ndarray((n,), kind, data.data, begin + offset, (1,))

    h = load(0, "<u8") * u64(0x9E3779B97F4A7C15)
    h ^= h >> u64(29)
    h += load(8, "<u8")
    h *= u64(0xBF58476D1CE4E5B9)
    h ^= h >> u64(31)
    h += load(16, "<u4")
    h *= u64(0x94D049BB133111EB)
    h ^= h >> u64(32)
    return h


class Spans:
    """Runs of windows with one anchor: place of the first window, number of windows, anchor hash."""

    def __init__(self, c: Chunk, width: int):
        reach = width - ANCHOR + 1
        long = c.lengths >= width
        begins, ends = c.starts[long], c.ends[long] - width + 1
        valid = np.zeros(c.size + 1, np.int8)
        valid[begins] = 1
        np.subtract.at(valid, ends, 1)
        valid = np.cumsum(valid, dtype=np.int8).view(bool)
        opens = np.zeros(c.size + 1, bool)
        opens[begins] = True
        opens[np.minimum(ends, c.size)] = True
        data = np.concatenate([c.bytes, np.zeros(width + 16, np.uint8)])
        at, anchors, last = [], [], u64(0)
        for b in range(0, c.size, BLOCK):
            n = min(BLOCK, c.size - b)
            h = gram_hashes(data, b, n + reach - 1)
            # The low bits tell the place, so that two equal grams in one window stay apart.
            h &= ~u64(63)
            h |= np.arange(b, b + len(h)).astype(np.uint64) & u64(63)
            step = 1
            while step * 2 <= reach:
                h = np.minimum(h[:-step], h[step:])
                step *= 2
            if step < reach:
                h = np.minimum(h[:-(reach - step)], h[reach - step:])
            new = np.empty(n, bool)
            new[0] = h[0] != last
            np.not_equal(h[1:], h[:-1], out=new[1:])
            new |= opens[b:b + n]
            last = h[-1]
            i = np.flatnonzero(new)
            at.append(i + b)
            anchors.append(h[i])
        at = np.concatenate([*at, [c.size]]).astype(np.int64)
        anchors = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        keep = valid[at[:-1]]
        self.at, self.count = at[:-1][keep], np.diff(at)[keep]
        self.key = c.keys[np.searchsorted(c.ends, self.at, side="right")]
        # Minima crowd at the low end; mixed again they fill all buckets alike.
        self.anchor = chunks.mix(anchors[keep] & ~u64(63)) >> u64(64 - FILTER_BITS)


def string_hashes(c: Chunk, at: np.ndarray, length: np.ndarray | int, width: int) -> np.ndarray:
    """64-bit hashes of strings at `at`, between `width` and `2 * width - ANCHOR` bytes long."""
    end = at + length
    places = [at + i for i in [*range(0, width - 7, 8), width - 8]]
    if not isinstance(length, int):
        places += [end - i for i in range(8, width - ANCHOR + 8, 8)]
    h = np.zeros(len(at), np.uint64)
    h += np.asarray(length).astype(np.uint64)
    for p in places:
        h ^= c.words(p)
        h *= u64(0x9E3779B97F4A7C15)
        h ^= h >> u64(29)
    return chunks.mix(h)


def windows(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of all windows of the spans."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first - at, count)


# --- runs ---------------------------------------------------------------------------------------

class Strings:
    """The distinct strings of a chunk, told apart by 64-bit hashes, with the smallest id of each."""

    def __init__(self, hashes: np.ndarray, keys: np.ndarray):
        self.hash, self.first, self.group = np.unique(hashes, return_index=True,
                                                      return_inverse=True)
        self.ids, self.last = chunks.first_and_last(self.group, keys, len(self.hash))

    def gone(self, keys: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """Which occurrences a smaller id has as well, in this chunk or elsewhere."""
        return smaller[self.group] | (keys > self.ids[self.group])

    def run(self, chunk: int, c: Chunk, at: np.ndarray, length: np.ndarray, cuts: list[bytes],
            longest: int) -> pa.Table:
        """The strings in order, as one front-coded row per range."""
        text = c.bytes.tobytes()
        strings = [text[a:a + n] for a, n in zip(at[self.first].tolist(),
                                                 length[self.first].tolist(), strict=True)]
        order = sorted(range(len(strings)), key=strings.__getitem__)
        strings = [strings[i] for i in order]
        order = np.array(order, np.uint32)
        ends = [0, *(bisect_left(strings, s) for s in cuts), len(strings)]
        rows: dict[str, list] = {k.split()[0]: [] for k in RUN.split(", ")}
        for r, (i, j) in enumerate(pairwise(ends)):
            if i == j:
                continue
            prefixes, lengths, tails = front_coded(strings[i:j], longest)
            for k, v in zip(rows, (r, chunk, j - i, chunks.pack(prefixes), chunks.pack(lengths),
                                   tails, chunks.pack(self.ids[order[i:j]]),
                                   chunks.pack(order[i:j])), strict=True):
                rows[k].append(v)
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types, strict=True)})


def flagged(said: pa.Table, phase: int, n: int) -> np.ndarray:
    """Which of a chunk's strings a smaller id has elsewhere."""
    out = np.zeros(n, bool)
    for _, slots in chunks.replies(said, phase):
        out[chunks.unpack_sorted(slots).astype(np.int64)] = True
    return out


def front_coded(strings: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the one before, length, and what follows the shared prefix.

    Prefixes are those of the strings padded with zero bytes and followed by their length, the form
    in which they are compared, so that none is a prefix of another.
    """
    grid = np.frombuffer(b"".join(s.ljust(longest, b"\0") + bytes([len(s)]) for s in strings),
                         np.uint8).reshape(len(strings), longest + 1)
    prefixes = np.zeros(len(strings), np.uint8)
    prefixes[1:] = np.argmax(grid[1:] != grid[:-1], axis=1)
    lengths = grid[:, -1]
    place = np.arange(longest)
    tails = grid[:, :-1][(place >= prefixes[:, None]) & (place < lengths[:, None])].tobytes()
    return prefixes, lengths, len(tails).to_bytes(8, "little") + pa.compress(
        tails, codec="zstd", asbytes=True)


def decoded(prefixes: bytes, lengths: bytes, tails: bytes, longest: int
            ) -> tuple[list[int], list[int]]:
    """A run's strings as numbers in string order, and how many bytes follow the shared prefix."""
    shared, size = chunks.unpack(prefixes, "u1"), chunks.unpack(lengths, "u1").tolist()
    n = int.from_bytes(tails[:8], "little")
    text = pa.decompress(tails[8:], n, codec="zstd", asbytes=True) if n else b""
    values, last, at = [], b"", 0
    for p, m in zip(shared.tolist(), size, strict=True):
        rest = max(0, m - p)
        last = (last[:p] + text[at:at + rest]).ljust(longest, b"\0")[:longest] + bytes([m]) \
            if p <= longest else last
        at += rest
        values.append(int.from_bytes(last))
    return values, (longest + 1 - shared.astype(np.int64)).tolist()


def merged(values: list[list[int]], apart: list[list[int]]) -> Iterator[tuple[int, int, bool]]:
    """Merge sorted runs with a loser tree; yields run, place in it, and if equal to the last one.

    `apart` holds for each string the number of bytes from where it parts with the one before it in
    its run, to the end. A node keeps the run that lost there and how far apart it is from the last
    output. Of two that lead to a node, the one that parts later from the last output is smaller and
    no byte is looked at; the loser stays as far apart from the winner as it was from the output.
    Only if both part at the same byte are they compared, and their own parting place is kept.
    """
    never, far = 1 << 4096, 1 << 20
    k = 1
    while k < len(values):
        k *= 2
    now = [v[0] if v else never for v in values] + [never] * (k - len(values))
    gap = [far] * k
    place = [0] * k
    loser = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if now[b] < now[a]:
            a, b = b, a
        loser[node] = b
        gap[b] = far if now[b] == never else ((now[a] ^ now[b]).bit_length() + 7) >> 3
        return a

    w, d = build(1), far
    while now[w] != never:
        yield w, place[w], d == 0
        run = values[w]
        p = place[w] = place[w] + 1
        if p < len(run):
            x = now[w] = run[p]
            d = apart[w][p]
        else:
            x, d = never, far
            now[w] = never
        node = (w + k) >> 1
        while node:
            other = loser[node]
            g = gap[other]
            if g < d:
                gap[w] = d
                loser[node] = w
                w, d, x = other, g, now[other]
            elif g == d and d != far:
                y = now[other]
                if y < x:
                    gap[w] = ((x ^ y).bit_length() + 7) >> 3
                    loser[node] = w
                    w, x = other, y
                else:
                    gap[other] = ((x ^ y).bit_length() + 7) >> 3
            node >>= 1


def merging(phase: int, longest: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Range task: merge the runs; tell each the places of strings that a smaller id has too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = chunks.ordered(table)
        counts = table["n"].to_pylist()
        values, apart = [], []
        for p, m, t in zip(table["prefixes"], table["lengths"], table["tails"], strict=True):
            v, a = decoded(p.as_py(), m.as_py(), t.as_py(), longest)
            values.append(v)
            apart.append(a)
        starts = np.cumsum([0, *counts]).tolist()
        order, equal = [], bytearray()
        for r, p, same in merged(values, apart):
            order.append(starts[r] + p)
            equal.append(same)
        del values, apart
        order = np.array(order, np.int64)
        ids = np.concatenate([chunks.unpack(x.as_py(), "<i8") for x in table["ids"]])[order]
        first = ~np.frombuffer(bytes(equal), bool)
        begin = np.flatnonzero(first)
        least = np.minimum.reduceat(ids, begin)[np.cumsum(first) - 1]
        found = np.zeros(len(ids), bool)
        found[order] = least < ids
        slots = np.concatenate([chunks.unpack(x.as_py(), "<u4") for x in table["slots"]])
        return chunks.answer(
            phase, key[0].as_py(), table["chunk"].to_pylist(), counts,
            np.where(found, slots.astype(np.int64), -1),
            lambda x: chunks.pack_sorted(np.sort(x[x >= 0]).astype(np.uint64)))

    return run


def splitters(docs: DataFrame, text: str, rows: int, ranges: int, longest: int) -> list[bytes]:
    """Strings that cut the suffixes into about equal ranges, from a bounded sample of the text.

    They set only how the work is shared out, never the result.
    """
    tries = 8
    share = min(1.0, SAMPLE / tries / max(1, rows))
    data = F.col(text).cast("binary")
    size = F.greatest(F.octet_length(data) - longest, F.lit(1))
    places = [
        F.substring(data, F.pmod(F.xxhash64(F.col(text), F.lit(i)), size).cast("int") + 1, longest)
        for i in range(tries)]
    sampled = docs.where(F.pmod(F.xxhash64(F.col(text), F.lit(-1)), F.lit(1 << 30))
                         <= int(share * (1 << 30))).limit(SAMPLE // tries)
    got = sorted({bytes(s) for row in sampled.select(*places).collect() for s in row if s})
    if not got:
        return []
    return sorted({got[i * len(got) // ranges] for i in range(1, ranges)})


# --- the operator -------------------------------------------------------------------------------

def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH,
          chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """Remove every byte covered by a `width`-byte string that also starts under a smaller id.

    Texts are UTF-8 bytes; matches never cross documents and are judged on the input. Returns the
    rows of `docs` with `text` as the kept bytes (binary, as a cut may fall inside a character), and
    `n_bytes`, `n_removed`, `removed` (byte intervals, maximal) and `kept_sha256`; columns so named
    are replaced, all others kept. Null texts count as empty. A null id is after every other; rows of
    equal id are one document, in which nothing repeats. An empty table gives an empty one.
    """
    if not ANCHOR < width <= 64:
        raise ValueError(f"width must lie between {ANCHOR + 1} and 64 bytes")
    longest = 2 * width - ANCHOR
    sizes = chunks.measure(docs, text, chunk_bytes)
    ranges = chunks.parts(sizes.text_bytes, RANGE_BYTES)
    at_anchor = chunks.parts(sizes.text_bytes / 16)
    at_window = chunks.parts(sizes.text_bytes / 8)
    cuts = splitters(docs, text, sizes.rows, ranges, longest)
    df = chunks.dealt(docs, sizes.chunks, id, text)
    found = FOUND.format(rest=df.schema["rest"].dataType.simpleString())

    class State:
        """What a chunk knows after the replies so far; each phase derives it anew."""

        def __init__(self, c: Chunk, said: pa.Table | None, phases: int):
            s = Spans(c, width)
            self.anchors, group = np.unique(s.anchor, return_inverse=True)
            if phases < 1:
                return
            least, most = chunks.first_and_last(group, s.key, len(self.anchors))
            shared = (chunks.reply_bits(said, 1) | (least != most))[group]
            self.at, key = s.at[shared], s.key[shared]
            self.length = s.count[shared] + width - 1
            self.strings = Strings(string_hashes(c, self.at, self.length, width), key)
            if phases < 2:
                return
            gone = self.strings.gone(key, flagged(said, 2, len(self.strings.hash)))
            self.begins, self.ends = self.at[gone], (self.at + self.length)[gone]
            count = s.count[shared][~gone]
            self.at, key = windows(self.at[~gone], count), np.repeat(key[~gone], count)
            hashes = string_hashes(c, self.at, width, width)
            self.filter, group = np.unique(hashes >> u64(64 - FILTER_BITS), return_inverse=True)
            if phases < 3:
                return
            least, most = chunks.first_and_last(group, key, len(self.filter))
            again = (chunks.reply_bits(said, 3) | (least != most))[group]
            self.at, key = self.at[again], key[again]
            self.length = np.full(len(self.at), width)
            self.strings = Strings(hashes[again], key)
            if phases < 4:
                return
            at = self.at[self.strings.gone(key, flagged(said, 4, len(self.strings.hash)))]
            self.begins = np.concatenate([self.begins, at])
            self.ends = np.concatenate([self.ends, at + width])

    def anchors(chunk: int, c: Chunk) -> pa.Table:
        return chunks.ask(chunk, at_anchor, FILTER_BITS, State(c, None, 0).anchors)

    def span_run(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        s = State(c, said, 1)
        return s.strings.run(chunk, c, s.at, s.length, cuts, longest)

    def filter_windows(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        return chunks.ask(chunk, at_window, FILTER_BITS, State(c, said, 2).filter)

    def window_run(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        s = State(c, said, 3)
        return s.strings.run(chunk, c, s.at, s.length, cuts, longest)

    def remove(chunk: int, c: Chunk, said: pa.Table) -> pa.Table:
        s = State(c, said, 4)
        return kept(c, chunks.covered(c.size, s.begins, s.ends))

    def by_range(asked: DataFrame, phase: int) -> DataFrame:
        merge = chunks.tidy(merging(phase, longest))
        return asked.groupBy("range").applyInArrow(
            lambda key, table: merge(key, table), chunks.REPLY).repartition("chunk")

    said = [chunks.by_bucket(chunks.by_chunk(df, anchors, chunks.ASK), chunks.recurring(1))]
    said.append(by_range(chunks.with_replies(df, said, span_run, RUN), 2))
    said.append(chunks.by_bucket(chunks.with_replies(df, said, filter_windows, chunks.ASK),
                                 chunks.recurring(3)))
    said.append(by_range(chunks.with_replies(df, said, window_run, RUN), 4))
    out = chunks.with_replies(df, said, remove, found)
    return chunks.returned(out, docs, text, ["n_bytes", "n_removed", "removed", "kept_sha256"])


def kept(c: Chunk, gone: np.ndarray) -> pa.Table:
    begins, ends = chunks.runs(gone, c.starts)
    i, j = np.searchsorted(begins, c.starts), np.searchsorted(begins, c.ends)
    texts, removed, lost, digests = [], [], [], []
    for d, t in enumerate(c.texts):
        spans = [(int(b - c.starts[d]), int(e - c.starts[d]))
                 for b, e in zip(begins[i[d]:j[d]], ends[i[d]:j[d]], strict=True)]
        left, last = [], 0
        for b, e in spans:
            left.append(t[last:b])
            last = e
        t = b"".join([*left, t[last:]]) if spans else t
        texts.append(t)
        removed.append([{"begin": b, "end": e} for b, e in spans])
        lost.append(sum(e - b for b, e in spans))
        digests.append(hashlib.sha256(t).hexdigest())
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "key": c.table["key"], "text": pa.array(texts, pa.binary()), "rest": c.table["rest"],
        "n_bytes": pa.array(c.lengths, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
        "removed": pa.array(removed, span), "kept_sha256": pa.array(digests)})


def whole_characters(data: Column) -> Column:
    """Kept bytes as text, without what a cut has left of a split character."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return text(data)

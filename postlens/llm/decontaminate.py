"""Benchmark decontamination by templates, which also catch questions with other names and numbers.

Texts become tokens: words, numbers, units after a number, and names (a capital inside a sentence).
The last three turn into typed placeholders. Windows of `WIDTH` template tokens of the benchmark are
hashed; a document window with the same hash is a candidate. Windows in a row that fit the same item
at the same shift form a run. Of a run each longest part counts whose slots are consistent: a value of
the item stands for one value of the document, and a name of the document for one of the item (numbers
and units of an item may become the same). All this is done twice: over the tokens, and over units in
which any capital is a name, also where it opens a sentence, and names side by side are one.

Items in which no window has enough plain words, such as short ones, are looked up whole, slots by
value. Scripts without spaces between words have a token for each character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.llm.minhash import sliced
from postlens.llm.substring_dedup import BASES, rolling
from postlens.session import stage

WIDTH = 10
#: Different plain words that a window needs, so that a row of slots or one word alone fits nothing.
PLAIN = 5
#: Bytes of benchmark text that go to all tasks at once; a larger benchmark takes several passes.
PART_BYTES = 8 << 20
#: Text that a task searches at once. What it holds of that text's tokens is about a hundred times the text,
#: and Spark's Python workers keep beside them what earlier stages have left.
SLICE_BYTES = 1 << 20

UNITS = """mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams kilogram
kilograms oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
mph kmh degree degrees percent dollar dollars euro euros cent cents usd eur""".split()

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
SLOT = np.array([0, 0x5BD1E995A1B2C3D5, 0x6C62272E07BB0143, 0x7FEB352D8A5CD789], np.uint64)

FOUND = "key long, text_hash long, " \
    "hits array<struct<item_id:long,begin:long,end:long,tokens:long>>"

_kind = np.zeros(256, np.uint8)
_kind[48:58] = 2
_kind[65:91] = _kind[97:123] = 1
_kind[128:] = 1
_stop = np.zeros(256, bool)
_stop[[10, 13, 33, 46, 58, 63]] = True
#: Signs of arithmetic; they are no tokens, but items that are looked up whole must agree in them.
_sign = np.zeros(256, np.uint64)
_sign[list(b"%*+/<=>^")] = SLOT[1] * np.arange(1, 9, dtype=np.uint64)
MINUS = SLOT[2]
#: What keeps names apart that stand side by side, besides the ends of sentences.
_apart = _stop.copy()
_apart[list(b'"(),/;[]{|}')] = True

#: First and last characters of scripts without spaces between words: Thai, Lao, Tibetan and Myanmar,
#: Khmer, Tai scripts, Balinese, Han, kana and bopomofo, Javanese and more Myanmar, Tai Viet, wide forms.
UNSPACED = np.array([
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C), (0x3041, 0x30FA),
    (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])
#: Their punctuation, which is no token.
MARKS = np.array([(0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F),
                  (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40),
                  (0xFF5B, 0xFF65)])
STOPS = [0x3002, 0xFF01, 0xFF0E, 0xFF1A, 0xFF1F, 0xFF61]


#: Characters whose small letter has another number of bytes; they stay as they are. All are below 0x10000.
UNEVEN = re.compile("([" + "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000)))
                                   if len(c.lower().encode()) != len(c.encode())) + "]+)")


def lower(text: str) -> str:
    """Small letters, each at the bytes of its capital."""
    if text.isascii() or not UNEVEN.search(text):
        return text.lower()
    return "".join(x if i % 2 else x.lower() for i, x in enumerate(UNEVEN.split(text)))


class Tokens:
    """Template tokens of several texts: place, document, canonical hash, value hash, type."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        low = [lower(t).encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        self.text_starts = starts = ends - size
        n = int(size.sum())
        a = np.frombuffer(b"".join(raw) + bytes(64), np.uint8)
        b = np.frombuffer(b"".join(low) + bytes(64), np.uint8)
        kind = _kind[a[:n]]
        # A point or comma between digits belongs to the number.
        if n > 2:
            mid = (a[1:n - 1] == 46) | (a[1:n - 1] == 44)
            mid &= (kind[:-2] == 2) & (kind[2:] == 2)
            kind[1:-1][mid] = 2
        stop = _stop[a[:n]]
        lead = np.flatnonzero(a[:n] >= 0xE0)
        code, long = code_points(a, lead)
        mark = within(code, MARKS)
        for i in range(3):
            kind[lead[mark] + i] = 0
        stop[lead[np.isin(code, STOPS)]] = True
        alone = within(code, UNSPACED)
        change = np.zeros(n + 1, bool)
        change[0] = change[n] = True
        change[1:n] = kind[1:] != kind[:-1]
        change[lead[alone]] = change[lead[alone] + long[alone]] = True
        change[starts[starts < n]] = True
        at = np.flatnonzero(change)
        keep = kind[at[:-1]] > 0 if n else np.zeros(0, bool)
        self.begin, self.end = at[:-1][keep], at[1:][keep]
        self.doc = np.searchsorted(ends, self.begin, side="right")
        self.value = word_values(b, self.begin, self.end)
        first = np.ones(len(self.begin), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        upper = np.concatenate([[0], np.cumsum(a[:n] != b[:n])])
        capitals = upper[self.end] - upper[self.begin]
        leads = upper[np.minimum(self.begin + 2, n)] - upper[self.begin] > 0
        stops = np.concatenate([[0], np.cumsum(stop)])
        opens = first.copy()
        opens[1:] |= stops[self.begin[1:]] > stops[self.end[:-1]]
        number = kind[self.begin] == 2 if n else np.zeros(0, bool)
        after = np.zeros(len(number), bool)
        after[1:] = number[:-1] & ~first[1:]
        self.type = np.zeros(len(number), np.uint8)
        capital = leads & (capitals == 1)
        self.type[capital & ~opens] = NAME
        self.type[after & np.isin(self.value, unit_values())] = UNIT
        self.type[number] = NUMBER
        self.canonical = np.where(self.type > 0, SLOT[self.type], self.value)
        self.bytes = a
        self.first, self.last = np.arange(len(number)), np.arange(1, len(number) + 1)
        self.name = (self.type == NAME) | capital & (self.type == WORD)
        parted = np.concatenate([[0], np.cumsum(_apart[a[:n]] | stop)])
        self.joined = np.zeros(len(number), bool)
        self.joined[1:] = self.name[1:] & self.name[:-1] & ~opens[1:] \
            & (parted[self.begin[1:]] == parted[self.end[:-1]])

    def signs(self) -> np.ndarray:
        """For each token the signs of arithmetic between the one before it and it, as a number; a minus
        only between numbers, as elsewhere it is a hyphen."""
        before = np.concatenate([[np.uint64(0)], np.cumsum(_sign[self.bytes])])
        minus = np.concatenate([[0], np.cumsum(self.bytes == 45)])
        out = np.zeros(len(self.begin), np.uint64)
        out[1:] = before[self.begin[1:]] - before[self.end[:-1]]
        number = self.type == NUMBER
        both = number[1:] & number[:-1] & (minus[self.begin[1:]] > minus[self.end[:-1]])
        out[1:][both] += MINUS
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows that lie in one text. A window with names has two:
        with the names as slots and as plain words, so that a text in capitals is known too."""
        n = len(self.begin) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1:])
        names = self.type == NAME
        before = np.concatenate([[0], np.cumsum(names)])
        named = at[before[at + width] > before[at]]
        plain = np.where(names, self.value, self.canonical)
        return np.concatenate([at, named]), np.concatenate([
            rolling(self.canonical, width, BASES[0])[at], rolling(plain, width, BASES[0])[named]])


class Units:
    """The tokens with every capital as a name and names side by side as one."""

    def __init__(self, t: Tokens):
        self.first = np.flatnonzero(~t.joined)
        self.last = np.append(self.first[1:], len(t.joined))[:len(self.first)]
        size = self.last - self.first
        self.doc, self.value = t.doc[self.first], t.value[self.first]
        many = np.flatnonzero(size > 1)
        for i in range(1, int(size.max(initial=1))):
            many = many[size[many] > i]
            self.value[many] = chunks.mix(self.value[many] * BASES[1] + t.value[self.first[many] + i])
        self.type = np.where(t.name[self.first], NAME, t.type[self.first])
        self.canonical = np.where(self.type > 0, SLOT[self.type], self.value)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First units and hashes of the windows that lie in one text."""
        n = len(self.first) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1:])
        return at, rolling(self.canonical, width, BASES[0])[at]


def code_points(a: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of three or four bytes that begin at the places `lead`, and how many bytes."""
    x = [a[lead + i].astype(np.int64) & 63 for i in range(4)]
    three = (x[0] & 15) << 12 | x[1] << 6 | x[2]
    four = (x[0] & 7) << 18 | x[1] << 12 | x[2] << 6 | x[3]
    long = a[lead] >= 0xF0
    return np.where(long, four, three), np.where(long, 4, 3)


def within(code: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Whether each character lies in one of the ranges, which are in order."""
    return np.searchsorted((ranges + [0, 1]).ravel(), code, side="right") % 2 == 1


def word_values(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token."""
    view = np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))
    length = end - begin
    h = length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    live, offset = np.arange(len(begin)), 0
    while len(live):
        left = length[live] - offset
        x = view[begin[live] + offset]
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = chunks.mix(h[live] ^ x)
        offset += 8
        live = live[left > 8]
    return h


def unit_values() -> np.ndarray:
    text = " ".join(UNITS).encode()
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return word_values(np.frombuffer(text + bytes(64), np.uint8),
                       ends - np.array([len(u) for u in UNITS]), ends)


class Keys:
    """Hashes with a number each."""

    def __init__(self, key: np.ndarray, number: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.number = key[order], number[order]
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[self.key >> np.uint64(44)] = True

    def find(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of `at` and the numbers whose hashes are equal, in pairs."""
        some = self.coarse[key >> np.uint64(44)]
        at, key = at[some], key[some]
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        n = high - low
        return np.repeat(at, n), \
            self.number[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]


class Benchmark:
    """The windows of the items, by hash; items without one that has enough plain words, by their first
    tokens, `width` at most."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        self.ids, self.width = np.array(ids, np.int64), width
        self.tokens = t = Tokens(texts)
        self.units = Units(t)
        self.keys, bare = [], np.ones(len(ids), bool)
        for x in (t, self.units):
            at, key = x.windows(width)
            rich = np.array([len(set(x.value[i:i + width][x.type[i:i + width] == WORD].tolist()))
                             >= PLAIN for i in at], bool)
            self.keys.append(Keys(key[rich], at[rich]))
            if x is t:
                bare[t.doc[at[rich]]] = False
        self.size = np.bincount(t.doc, minlength=len(ids))
        first = np.cumsum(self.size) - self.size
        bare &= self.size > 0
        self.whole = {}
        for n in np.unique(np.minimum(self.size[bare], width)).tolist():
            item = first[bare & (np.minimum(self.size, width) == n)]
            self.whole[n] = Keys(rolling(t.value, n, BASES[0])[item], item)
        self.signs = t.signs() if self.whole else None

    def hits(self, texts: list[str], parts: bool = False) -> list[list[tuple[int, int, int, int]]]:
        """For each text the runs (item, first byte, end byte, tokens) that are consistent from end to
        end; with `parts` every longest consistent part of a run of at least `width` tokens."""
        # By document: item, its first token and the bytes, so that what both ways find counts once.
        out: list[dict] = [{} for _ in texts]
        d = Tokens(texts)

        def add(x: int, y: int, m: int) -> None:
            doc = d.doc[x]
            start = d.text_starts[doc]
            out[doc][int(self.tokens.doc[y]), int(y), int(d.begin[x] - start),
                     int(d.end[x + m - 1] - start)] = int(m)

        for t, z, keys in ((self.tokens, d, self.keys[0]), (self.units, Units(d), self.keys[1])):
            for x, y, m in self.runs(t, z, keys):
                for low, high in self.consistent(z, x, y, m, t):
                    if parts or high - low == m:
                        at = z.first[x + low]
                        add(at, t.first[y + low], z.last[x + high - 1] - at)
        for x, y, m in self.copies(d):
            add(x, y, m)
        return [[(int(self.ids[i]), b, e, m) for (i, _, b, e), m in found.items()] for found in out]

    def runs(self, t: Tokens | Units, d: Tokens | Units, keys: Keys) -> Iterator[tuple[int, int, int]]:
        """Place in the document, place in the item and length of each run of windows."""
        at, key = d.windows(self.width)
        here, there = keys.find(key, at)
        order = np.lexsort((here, here - there))
        here, there = here[order], there[order]
        if len(here):
            once = np.concatenate([[True], (here[1:] != here[:-1]) | (there[1:] != there[:-1])])
            here, there = here[once], there[once]
        new = np.ones(len(here) + 1, bool)
        new[1:-1] = (here[1:] - there[1:] != here[:-1] - there[:-1]) | (here[1:] - here[:-1] != 1) \
            | (t.doc[there[1:]] != t.doc[there[:-1]]) | (d.doc[here[1:]] != d.doc[here[:-1]])
        for i, j in pairwise(np.flatnonzero(new).tolist()):
            yield here[i], there[i], j - i - 1 + self.width

    def copies(self, d: Tokens) -> Iterator[tuple[int, int, int]]:
        """First token, the item's first token and length of each copy of an item looked up whole."""
        signs = d.signs() if self.whole else None
        for n, keys in self.whole.items():
            if len(d.begin) < n:
                continue
            at = np.flatnonzero(d.doc[:len(d.doc) - n + 1] == d.doc[n - 1:])
            here, there = keys.find(rolling(d.value, n, BASES[0])[at], at)
            for x, y in zip(here.tolist(), there.tolist(), strict=True):
                m = int(self.size[self.tokens.doc[y]])
                if x + m <= len(d.doc) and d.doc[x] == d.doc[x + m - 1] \
                        and np.array_equal(d.value[x:x + m], self.tokens.value[y:y + m]) \
                        and np.array_equal(signs[x + 1:x + m], self.signs[y + 1:y + m]):
                    yield x, y, m

    def consistent(self, d: Tokens | Units, x: int, y: int, m: int, t: Tokens | Units | None = None
                   ) -> list[tuple[int, int]]:
        """The longest parts of a run, of at least `width` tokens, whose slots are consistent."""
        t = t or self.tokens
        kind = t.type[y:y + m]
        slots = np.flatnonzero(kind)
        out, low = [], 0
        ours: dict[int, tuple[int, int]] = {}
        theirs: dict[int, tuple[int, int]] = {}
        for i, a, b, k in zip(slots.tolist(), t.value[y + slots].tolist(),
                              d.value[x + slots].tolist(), kind[slots].tolist(), strict=True):
            # A part that holds this slot begins after the last one that contradicts it.
            value, last = ours.get(a, (b, -1))
            after = last + 1 if value != b else 0
            if k == NAME:
                value, last = theirs.get(b, (a, -1))
                after = max(after, last + 1 if value != a else 0)
                theirs[b] = a, i
            ours[a] = b, i
            if after > low:
                if i - low >= self.width:
                    out.append((low, i))
                low = after
        return [*out, (low, m)] if m - low >= self.width else out


def found(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item_id: str, item_text: str,
          width: int) -> DataFrame:
    """`FOUND` of the documents with hits; one pass over them for each part of the benchmark."""
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()) \
        .select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    texts = docs.select(docs[id].cast("long").alias("key"), F.xxhash64(docs[text]).alias("text_hash"),
                        docs[text].alias("text"))
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r.i for r in rows], [r.t for r in rows]))

        def search(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Benchmark(*shared.value, width)
            for table in sliced(it, SLICE_BYTES):
                hits = known.hits([t or "" for t in table["text"].to_pylist()], parts=True)
                row = [i for i, h in enumerate(hits) if h]
                names = ("item_id", "begin", "end", "tokens")
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in names]))
                yield pa.RecordBatch.from_arrays(
                    [table[k].combine_chunks().take(pa.array(row, pa.int64()))
                     for k in ("key", "text_hash")] + [pa.array(
                         [[dict(zip(names, h, strict=True)) for h in sorted(hits[i])] for i in row],
                         kind)], names=["key", "text_hash", "hits"])

        found = texts.mapInArrow(search, FOUND)
        if parts > 1:
            found = stage(found, "hits")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = WIDTH
                  ) -> DataFrame:
    """`id`, `text_hash`, `item_id`, `begin`, `end` (bytes), `tokens` for each run found.

    Null texts, items without id, and items without a letter or digit give nothing; items without a
    window of `PLAIN` different plain words are found as whole copies only. Equal items are each reported, rows of equal id each on their own. Empty tables give an empty one.
    """
    return found(docs, benchmark, id, text, item_id, item_text, width) \
        .select(F.col("key").alias(id), "text_hash", F.explode("hits").alias("h")) \
        .select(id, "text_hash", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
          width: int = WIDTH) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage."""
    hits = stage(contamination(docs, benchmark, id, text, width=width)
                 .select(F.col(id).alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(),
                 "leaks")
    # by number, so that no column of `docs` clashes with those of the hits
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key, t = (F.col(f"c{docs.columns.index(c)}") for c in (id, text))
    mine = key.cast("long").eqNullSafe(F.col("hit_id")) & (F.xxhash64(t) == F.col("hit_hash"))
    return numbered.join(hits, mine, "left_anti").toDF(*docs.columns)

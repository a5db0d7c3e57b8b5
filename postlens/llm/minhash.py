"""Near copies by MinHash: universal hash minima, banding, verification, connected components.

1. Each text gives its set of word shingles as 64-bit hashes, `BANDS * ROWS` minima of universal
   hashes over it, and a fingerprint of the whole set. Texts of equal sets form a class, which one
   member stands for from here on, so a group of copies costs one row.
2. Minima are hashed by bands of `ROWS`. Each bucket takes as pivot its member that meets most others
   over all bands, and all members are held against it: pairs are as many as members. A pair first
   compares signatures, then whole sets. Links give components.
3. The members of all buckets of one pivot form a group; every pair that shares a bucket is in one.
   In groups whose members are still in different components, those are held against each other, in
   blocks of bounded size: by signature, then by whole sets. Only links that join two components
   leave the task, so rows never grow with the square of a group. A second round of components
   follows. No link between members of a bucket is lost.

A pair at the threshold shares no band with probability (1 - 0.75^4)^50 = 6e-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.llm.components import components
from postlens.llm.substring_dedup import BASES, rolling, word_hashes
from postlens.session import stage

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 50, 4
#: A pair whose signatures agree on less is no link: five standard deviations below the threshold.
LIKELY = 0.6
#: Members of a group that are compared with as many others in one go, about.
BLOCK = 384
#: Rows of groups that one task compares.
SLOT_ROWS = 8_000
#: Text whose words a task hashes at once; what it holds for that is many times the text.
SLICE_BYTES = 1 << 20

_random = np.random.default_rng(7)
FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

FEATURES = "key long, n long, d1 long, d2 long, bands array<long>, signature binary"


def shingle_sets(c: chunks.Chunk) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ASCII capitals count as small letters."""
    c.bytes = LOWER[c.bytes]
    words, counts = word_hashes(c)
    ends = np.cumsum(counts)
    grams = rolling(words, SHINGLE, BASES[0]) if len(words) >= SHINGLE else None
    for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if end - begin >= SHINGLE:
            yield np.unique(grams[begin:end - SHINGLE + 1])
        elif end > begin:
            yield rolling(words[begin:end], end - begin, BASES[1] + np.uint64(2 * (end - begin)))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes a * x + b over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(FACTORS), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        h = FACTORS[:, None] * x[None, i:i + 512]
        h += SHIFTS[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = chunks.mix(h ^ (rows[:, i] + np.uint64(i << 40)))
    return h.view(np.int64)


def featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(it, SLICE_BYTES):
        c = chunks.Chunk(batch)
        rows = {"n": [], "d1": [], "d2": [], "bands": [], "signature": []}
        for s in shingle_sets(c):
            rows["n"].append(len(s))
            rows["d1"].append(int(s.sum().view(np.int64)) if len(s) else 0)
            rows["d2"].append(int(chunks.mix(s.copy()).sum().view(np.int64)) if len(s) else 0)
            low = signature(s) if len(s) else None
            rows["bands"].append(band_hashes(low) if len(s) else None)
            rows["signature"].append(low.astype(np.uint8).tobytes() if len(s) else None)
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [c.table["key"].combine_chunks(),
             *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))],
            names=["key", *rows])


def sliced(it: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.Table]:
    """Batches cut so that none but a single row has much more text than `most` bytes."""
    for batch in it:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j > i:
                yield pa.Table.from_batches([batch.slice(i, j - i)])
    chunks.give_back()


def set_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(it, SLICE_BYTES):
        c = chunks.Chunk(batch)
        yield pa.RecordBatch.from_arrays(
            [c.table["key"].combine_chunks(),
             pa.array([s.tobytes() for s in shingle_sets(c)], pa.binary())], names=["key", "set"])


def likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for b in it:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[k].to_pylist()), np.uint8).reshape(len(b), -1)
                    for k in ("su", "sv"))
            ok = (x == y).mean(axis=1) >= LIKELY
            yield pa.RecordBatch.from_arrays(
                [b["u"].filter(pa.array(ok)), b["v"].filter(pa.array(ok))], names=["u", "v"])


def linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets overlap enough."""
    for b in it:
        ok = []
        for x, y in zip(b["xu"].to_pylist(), b["xv"].to_pylist(), strict=True):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            ok.append(100 * common >= PERCENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays(
            [b["u"].filter(pa.array(ok, pa.bool_())), b["v"].filter(pa.array(ok, pa.bool_()))],
            names=["u", "v"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs `at` (rows: left, right), by the cheaper of two ways."""
    sizes = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    one_by_one = float((sizes[0][at[:, 0]] + sizes[1][at[:, 1]]).sum()) * 2e-8 + len(at) * 1.5e-5
    if one_by_one > 0.2:
        values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        if len(left) * len(right) * len(values) * 1e-10 < one_by_one:
            row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
            out = np.zeros((len(left), len(right)), np.float32)
            for v in range(0, len(values), 4096):
                some = (place >= v) & (place < v + 4096)
                has = np.zeros((len(left) + len(right), 4096), np.float32)
                has[row[some], place[some] - v] = 1
                out += has[:len(left)] @ has[len(left):].T
            return out[at[:, 0], at[:, 1]].astype(np.int64)
    out = np.empty(len(at), np.int64)
    for i, (a, b) in enumerate(at.tolist()):
        both = np.concatenate([left[a], right[b]])
        both.sort(kind="stable")
        out[i] = (both[1:] == both[:-1]).sum()
    return out


class Forest:
    """Union-find over the components that a block holds."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.above.get(x, x)) != x:
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def apart(key: tuple, table: pa.Table) -> pa.Table:
    """Links between different components in one slot's blocks, as few as join them."""
    table = table.sort_by([("pivot", "ascending"), ("bi", "ascending"), ("bj", "ascending"),
                           ("key", "ascending")])
    of = [table[k].to_numpy() for k in ("pivot", "bi", "bj")]
    keys, comps, block = (table[k].to_numpy() for k in ("key", "component", "block"))
    signs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8) \
        .reshape(len(table), -1)
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    new = np.ones(len(table) + 1, bool)
    new[1:-1] = np.logical_or.reduce([x[1:] != x[:-1] for x in of])
    us, vs = [], []
    for i, j in pairwise(np.flatnonzero(new).tolist()):
        left = np.flatnonzero(block[i:j] == of[1][i]) + i
        right = np.flatnonzero(block[i:j] == of[2][i]) + i
        near = []
        for n, a in enumerate(left):
            b = np.flatnonzero((comps[right] != comps[a]) & ((keys[right] > keys[a])
                                                            | (of[1][i] != of[2][i])))
            if len(b):
                b = b[(signs[right[b]] == signs[a]).mean(axis=1) >= LIKELY]
                near.append(np.stack([np.full(len(b), n), b], axis=1))
        pairs = np.concatenate(near) if near else np.zeros((0, 2), np.int64)
        if not len(pairs):
            continue
        a, b = left[pairs[:, 0]], right[pairs[:, 1]]
        common = overlaps([sets[x] for x in left], [sets[x] for x in right], pairs)
        size = np.array([len(sets[x]) for x in range(i, j)])
        linked = 100 * common >= PERCENT * (size[a - i] + size[b - i] - common)
        forest = Forest()
        for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
            if forest.join(int(comps[x]), int(comps[y])):
                us.append(int(keys[x]))
                vs.append(int(keys[y]))
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `n_shingles`, `component_id`, `kept` for each row of `docs`.

    A set holds the distinct 5-word shingles, or the whole sequence of fewer words; a text that is
    null or has no words has an empty set and links with nothing. Documents link if
    100 * intersection >= 75 * union. Ids are expected to be unique: rows that repeat one are placed by
    their own texts, and where those differ links of either count for both. A null id comes after all
    others; its component is null if it is alone. An empty table gives an empty one.
    """
    key = F.coalesce(docs[id].cast("long"), F.lit(chunks.LAST_ID))
    texts = docs.select(key.alias("key"), docs[text].alias("text"))
    features = stage(texts.mapInArrow(featured, FEATURES), "features")
    classes = stage(features.where("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("rep")),
                    "classes")
    members = stage(features.where("n > 0").select("key", "n", "d1", "d2")
                    .join(classes, ["d1", "d2"]).select("key", "n", "rep"), "members")
    alone = features.join(classes.select(F.col("rep").alias("key")).distinct(), "key", "left_semi") \
        .where("n > 0")
    banded = alone.select("key", F.explode("bands").alias("band")).distinct()
    sizes = stage(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"),
                  "sizes")
    met = stage(banded.join(sizes, "band"), "met")
    rank = stage(met.groupBy("key").agg(F.sum("size").alias("meets")), "meets")
    pivots = stage(met.join(rank, "key").groupBy("band").agg(
        F.max_by("key", F.struct("meets", -F.col("key"))).alias("pivot")), "pivots")
    grouped = stage(met.join(pivots, "band").select("pivot", "key").where("key != pivot")
                    .distinct(), "grouped")
    signs = stage(alone.select("key", "signature"), "signatures")
    sets = stage(texts.join(rank.select("key"), "key", "left_semi")
                 .mapInArrow(set_rows, "key long, set binary").dropDuplicates(["key"]), "sets")

    pairs = grouped.select(F.col("key").alias("u"), F.col("pivot").alias("v"))
    near = stage(
        pairs.join(signs.select(F.col("key").alias("u"), F.col("signature").alias("su")), "u")
        .join(signs.select(F.col("key").alias("v"), F.col("signature").alias("sv")), "v")
        .mapInArrow(likely, "u long, v long"), "near")
    links = stage(
        near.join(sets.select(F.col("key").alias("u"), F.col("set").alias("xu")), "u")
        .join(sets.select(F.col("key").alias("v"), F.col("set").alias("xv")), "v")
        .mapInArrow(linked, "u long, v long"), "links")
    final = first = stage(components(links), "components")

    placed = stage(grouped.join(first.withColumnRenamed("node", "key"), "key", "left")
                   .withColumn("component", F.coalesce("component", "key")), "placed")
    split = stage(placed.groupBy("pivot").agg(
        F.min("component").alias("a"), F.max("component").alias("b"),
        F.count(F.lit(1)).alias("size")).where("a < b").select("pivot", "size"), "split")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = placed.join(split, "pivot") \
        .withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("pivot", "key", "component", "block", F.least("block", "other").alias("bi"),
                F.greatest("block", "other").alias("bj"))
    spread = stage(spread, "spread")
    rows = spread.count()
    if rows:
        slots = max(chunks.LEAST, -(-rows // SLOT_ROWS))
        late = spread.join(signs, "key").join(sets, "key").withColumn(
            "slot", F.pmod(F.xxhash64("pivot", "bi", "bj"), F.lit(slots)).cast("int"))
        more = stage(late.groupBy("slot").applyInArrow(apart, "u long, v long").distinct(), "late")
        final = stage(components(links.unionByName(more)), "components")
    named = members.join(final.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("key", "n", F.coalesce("component", "rep").alias("component"))
    none = features.where("n = 0").select("key", "n", F.col("key").alias("component"))
    last = F.lit(chunks.LAST_ID)
    return named.unionByName(none).select(
        F.nullif("key", last).alias(id), F.col("n").alias("n_shingles"),
        F.nullif("component", last).alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"))


def without_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` but those of which a near copy with a smaller id is kept. Of several rows
    of equal id all stay or go."""
    gone = stage(near_copies(docs, id, text).where("NOT kept").select(F.col(id).alias("gone")).distinct(),
                 "near-copies")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key = F.col(f"c{docs.columns.index(id)}").cast("long")
    return numbered.join(gone, key.eqNullSafe(F.col("gone")), "left_anti").toDF(*docs.columns)

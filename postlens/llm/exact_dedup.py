"""Exact copies by an extendible-hash index on shared files.

1. The load (bytes of text and a little for each row) is summed by the leading bits of a 64-bit key.
   From it a directory is planned: it starts with one bucket, an overfull bucket is split by its next
   bit, and the directory doubles when that bit is beyond its depth. A bucket that no bit can split,
   such as that of a text with very many copies, gets overflow pages.
2. Tasks fold the copies within a few megabytes into one row and send the rows to their buckets (rows
   of a bucket with several pages are dealt over them). The owner of a page looks a row up by key;
   equal keys chain, and only equal bytes are the same entry. Entries are written to the staging area
   with their text, key, digest and member ids.
3. Entries of buckets with several pages are told apart by a second key and folded again, as many rows
   at a time as a page holds, until each text has one entry. A text with so many copies that they fill
   a page is folded in several rounds; each leaves an eighth of its rows at most.

Planning keeps 8 to 16 numbers for each bucket on the driver, and each task the first key of each
bucket: at `PAGE_BYTES`, about 1 MB for a TB of text. Neither holds keys of documents.

Null text is empty. Of equal texts the row with the largest id stays, a null id being the smallest; of
rows with that same id exactly one stays. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import chunks
from postlens.llm.minhash import sliced
from postlens.session import stage

#: Load of a bucket, and of the page that one owner holds at once.
PAGE_BYTES = 16 << 20
#: Load of a row besides its text.
ROW_BYTES = 64
#: Bits by which the load is summed first, and bits that a bucket's range is planned with.
CELL_BITS = 16
SPARE_BITS = 3
#: Fewest rows of one text that a page folds.
LEAST_ROWS = 8

#: The page of a bucket that has only one.
SINGLE = -1

FOLDED = "bucket int, page int, key long, text binary, members array<long>"
ENTRY = "bucket int, page int, entry int, key long, text binary, members array<long>, at int, " \
    "top long, text_sha256 string"
Key = Callable[[Column], Column]


@dataclass
class Directory:
    """`slots` gives the bucket of each value of a key's first `depth` bits; the keys of bucket b share
    `bits[b]` bits. `pages[b]` owners hold its rows."""

    depth: int
    slots: np.ndarray
    bits: list[int]
    pages: np.ndarray

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def plan(cells: np.ndarray, page_bytes: int) -> Directory:
    """The directory for the load of 2^k cells of keys."""
    most = int(len(cells)).bit_length() - 1
    upto = np.concatenate([[0], np.cumsum(cells)])
    depth, slots, bits, first = 0, np.zeros(1, np.int32), [0], [0]

    def load(b: int) -> int:
        width = 1 << (most - bits[b])
        return int(upto[(first[b] + 1) * width] - upto[first[b] * width])

    overfull = [0]
    while overfull:
        b = overfull.pop()
        if load(b) <= page_bytes or bits[b] == most:
            continue
        if bits[b] == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        bits[b] += 1
        first[b] *= 2
        bits.append(bits[b])
        first.append(first[b] + 1)
        width = 1 << (depth - bits[b])
        slots[first[-1] * width:(first[-1] + 1) * width] = len(bits) - 1
        overfull += [b, len(bits) - 1]
    pages = np.array([max(1, -(-load(b) // page_bytes)) for b in range(len(bits))], np.int64)
    return Directory(depth, slots, bits, pages)


def loads(docs: DataFrame, bits: int) -> np.ndarray:
    """Load by the first `bits` bits of the key."""
    cell = F.shiftrightunsigned("key", 64 - bits).alias("cell")
    size = F.sum(F.octet_length("text")) + ROW_BYTES * F.count(F.lit(1))
    found = docs.groupBy(cell).agg(size.alias("load")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[found["cell"].to_numpy()] = found["load"].to_numpy()
    return out


def directory(docs: DataFrame, page_bytes: int) -> Directory:
    cells = loads(docs, CELL_BITS)
    bits = max(1, math.ceil(math.log2(max(1, cells.sum() / page_bytes)))) + SPARE_BITS
    if bits > CELL_BITS:
        cells = loads(docs, bits)
    else:
        cells = cells.reshape(1 << bits, -1).sum(axis=1)
    return plan(cells, page_bytes)


def folded(it: Iterator[pa.RecordBatch], where: Directory) -> Iterator[pa.RecordBatch]:
    """One row for the copies of a text within a slice, with their ids."""
    for table in sliced(it):
        coded = table["text"].combine_chunks().dictionary_encode()
        of = coded.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        n = np.bincount(of)
        lead = order[np.cumsum(n) - n]
        keys = table["key"].to_numpy()[lead]
        bucket = where.bucket(keys)
        pages = where.pages[bucket]
        page = np.where(pages > 1, table["salt"].to_numpy()[lead] % pages, SINGLE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(page, pa.int32()), pa.array(keys, pa.int64()),
             coded.dictionary,
             pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                      table["id"].combine_chunks().take(pa.array(order)))],
            names=["bucket", "page", "key", "text", "members"])


def chained(keys: list[int], texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """First row and all rows of each distinct text: rows of one key form a chain of texts."""
    chains: dict[int, list[list[int]]] = {}
    for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
        chain = chains.setdefault(key, [])
        for rows in chain:
            if texts[rows[0]] == text:
                rows.append(i)
                break
        else:
            chain.append([i])
    for chain in chains.values():
        for rows in chain:
            yield rows[0], rows


def largest(members: list[int | None]) -> tuple[int, int | None]:
    """Place and value of the largest id, its first place if it repeats; null is the smallest."""
    at = max(range(len(members)), key=lambda i: (members[i] is not None, members[i] or 0, -i))
    return at, members[at]


def owned(table: pa.Table) -> pa.Table:
    """The entries of a page."""
    texts, keys = table["text"].to_pylist(), table["key"].to_pylist()
    members = table["members"].to_pylist()
    rows = []
    for entry, (lead, same) in enumerate(chained(keys, texts)):
        ids = [x for i in same for x in members[i]]
        rows.append((entry, keys[lead], texts[lead], ids, *largest(ids),
                     hashlib.sha256(texts[lead]).hexdigest()))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.string()]
    names = ["entry", "key", "text", "members", "at", "top", "text_sha256"]
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()] * len(rows), pa.int32()),
        "page": pa.array([table["page"][0].as_py()] * len(rows), pa.int32()),
        **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}})


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", key: Key = F.xxhash64,
          page_bytes: int = PAGE_BYTES) -> DataFrame:
    """The staged entries. Entries of one text in different pages of a bucket are not united yet.

    Rows are dealt over pages by id, so a task that runs again sends them where it did before.
    """
    rows = docs.select(docs[id].cast("long").alias("id"),
                       F.coalesce(docs[text], F.lit("")).cast("binary").alias("text"))
    rows = rows.select("id", "text", key(F.col("text")).alias("key"))
    where = directory(rows, page_bytes)
    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt")
    one = chunks.tidy(owned)
    entries = rows.select("id", "text", "key", salt) \
        .mapInArrow(lambda it: folded(it, where), FOLDED) \
        .groupBy("bucket", "page").applyInArrow(lambda table: one(table), ENTRY)
    return stage(entries, "hash-index")


def merged(table: pa.Table) -> pa.Table:
    """Entries of one text among the rows: each row's reference with that of the entry it joins."""
    refs = table["ref"].to_pylist()
    found = [(refs[i], refs[lead]) for lead, same in
             chained(table["key2"].to_pylist(), table["text"].to_pylist()) for i in same]
    return pa.table({"ref": pa.array([a for a, _ in found], pa.string()),
                     "into": pa.array([b for _, b in found], pa.string())})


def united(entries: DataFrame, page_bytes: int) -> DataFrame:
    """`ref` and `root` of entries whose bucket has several pages: equal roots are equal texts."""
    rows = entries.select("ref", "text", F.xxhash64("key", "text_sha256").alias("key2"))
    roots = None
    while True:
        sizes = rows.groupBy("key2").agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum(F.octet_length("text")) + ROW_BYTES * F.count(F.lit(1))).alias("load")) \
            .select("key2", F.greatest(F.lit(1), F.least(
                F.ceil(F.col("load") / page_bytes),
                F.ceil(F.col("n") / LEAST_ROWS))).cast("int").alias("pages"))
        sizes = stage(sizes, "index-pages")
        found = stage(rows.join(sizes, "key2")
                      .withColumn("page", F.pmod(F.xxhash64("ref"), F.col("pages")))
                      .groupBy("key2", "page")
                      .applyInArrow(lambda table: merged(table), "ref string, into string"), "index-merge")
        roots = found.select("ref", F.col("into").alias("root")) if roots is None else stage(
            roots.join(found.select(F.col("ref").alias("root"), "into"), "root")
            .select("ref", F.col("into").alias("root")), "index-roots")
        if not sizes.where("pages > 1").limit(1).count():
            return roots
        rows = rows.join(found.where("ref = into").select("ref"), "ref")


def copies(docs: DataFrame, id: str = "doc_id", text: str = "text", key: Key = F.xxhash64,
           page_bytes: int = PAGE_BYTES) -> DataFrame:
    """`doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256` for each row of `docs`."""
    entries = index(docs, id, text, key, page_bytes)
    n = F.size("members").cast("long")
    out = entries.where(F.col("page") == SINGLE).select(
        "members", "at", "text_sha256", F.col("top").alias("keep_id"), n.alias("group_size"),
        F.lit(True).alias("wins"))
    paged = entries.where(F.col("page") != SINGLE)
    if not paged.isEmpty():
        several = paged.withColumn("ref", F.concat_ws("-", "bucket", "page", "entry"))
        rooted = several.select("ref", "members", "at", "top", "text_sha256") \
            .join(united(several, page_bytes), "ref")
        # by struct order: the largest id, then one entry among those that have it; null comes first
        lead = F.max(F.struct("top", "ref"))
        groups = rooted.groupBy("root").agg(lead.alias("lead"), F.sum(n).alias("group_size"))
        out = out.unionByName(rooted.join(groups, "root").select(
            "members", "at", "text_sha256", F.col("lead.top").alias("keep_id"), "group_size",
            (F.col("ref") == F.col("lead.ref")).alias("wins")))
    return out.select("keep_id", "group_size", "text_sha256", "at", "wins",
                      F.posexplode("members").alias("pos", "doc_id")) \
        .select("doc_id", "keep_id", "group_size",
                (F.col("wins") & (F.col("pos") == F.col("at"))).alias("kept"), "text_sha256")

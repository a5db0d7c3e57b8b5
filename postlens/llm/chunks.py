"""Asking all other documents about a chunk of documents, in packed form.

The substring and language-model operators all follow one pattern. Documents are dealt into chunks
by a hash of the row; a chunk is a few megabytes of text and is worked on with numpy inside one
task. To learn something about the rest of the corpus, a chunk sends its distinct sorted keys as one
packed row per hash bucket (or key range); the task of a bucket sees the keys of all chunks, and
answers each packed row with an array in the row's own order. A key that occurs a million times in a
chunk is sent once, so no hot key makes a hot task: a bucket gets at most one copy of a key from each
chunk.

The chunks' exchange is written once and reused by each later phase (Spark reuses equal exchanges
within a query), and a chunk is sorted before use, so every phase, and a task that is run again,
sees it alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a chunk holds on average; a task keeps a few arrays of that length.
CHUNK_BYTES = 8 << 20
#: Keys that one bucket holds on average.
BUCKET_KEYS = 2_000_000
#: Fewest chunks and buckets, so that small inputs are spread as well.
LEAST = 16
#: Stands for a null id: after every other one.
LAST_ID = (1 << 63) - 1

ASK = "bucket int, chunk int, n long, keys binary, more binary, ids binary"
REPLY = "chunk int, phase int, bucket int, n long, reply binary"


@dataclass(frozen=True)
class Sizes:
    rows: int
    text_bytes: int
    chunks: int


def measure(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Sizes:
    """Rows, bytes of text and number of chunks; one scan of the text column."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return Sizes(rows, size or 0, max(LEAST, -(-(size or 0) // chunk_bytes)))


def parts(keys: float, each: int = BUCKET_KEYS) -> int:
    """How many buckets or ranges hold `keys` keys."""
    return int(max(LEAST, -(-keys // each)))


def dealt(docs: DataFrame, n: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`chunk`, `key` (the id; null comes last), `text` and the other columns as `rest`."""
    key = F.coalesce(docs[id].cast("long"), F.lit(LAST_ID))
    others: list[Column] = [docs[c] for c in docs.columns if c != text]
    return docs.select(
        F.pmod(F.xxhash64(key, docs[text]), F.lit(n)).cast("int").alias("chunk"), key.alias("key"),
        docs[text].alias("text"), F.struct(*others).alias("rest"))


def returned(df: DataFrame, docs: DataFrame, text: str, added: list[str]) -> DataFrame:
    """The documents' columns in their order, then the added ones, which replace others so named."""
    own = [F.col(text) if c == text else F.col(f"rest.`{c}`").alias(c)
           for c in docs.columns if c not in added]
    return df.select(*own, *added)


def loosened(kind: pa.DataType) -> pa.DataType:
    """The type with all fields of its structs nullable, as Spark declares results."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, loosened(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, loosened(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, loosened(kind.item_type))
    return kind


class Chunk:
    """The documents of a chunk as one run of bytes, ordered by id, then text."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table.select(["key", "text"]),
                                [("key", "ascending"), ("text", "ascending")])
        table = table.take(order)
        if "rest" in table.column_names:
            at = table.column_names.index("rest")
            table = table.set_column(at, "rest", table["rest"].cast(loosened(table["rest"].type)))
        self.table = table
        self.keys = table["key"].to_numpy()
        self.texts = [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.size = int(self.lengths.sum())
        # Padded, so that wide loads near the end stay inside.
        self.bytes = np.frombuffer(b"".join(self.texts) + bytes(64), np.uint8)

    def words(self, at: np.ndarray, offset: int = 0) -> np.ndarray:
        """Little-endian 8-byte loads at `at + offset`."""
        view = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes.data, 0, (1,))
        return view[at + offset]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values in place, so that high and low bits both serve."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: equal high bytes cost next to nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return len(a).to_bytes(8, "little") + pa.compress(
        np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    raw = pa.decompress(data[8:], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers by their differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def limits(buckets: int, bits: int) -> np.ndarray:
    """First key of every bucket but the first, for keys of so many bits."""
    return np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)


def ask(chunk: int, buckets: int, bits: int, keys: np.ndarray, more: np.ndarray | None = None,
        ids: np.ndarray | None = None) -> pa.Table:
    """Ascending keys of a chunk as one packed row per bucket."""
    cuts = np.concatenate([[0], np.searchsorted(keys, limits(buckets, bits)), [len(keys)]])
    rows = [(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return pa.table({
        "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
        "chunk": pa.array([chunk] * len(rows), pa.int32()),
        "n": pa.array([int(j - i) for _, i, j in rows], pa.int64()),
        "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in rows], pa.binary()),
        "more": pa.array([None if more is None else pack(more[i:j]) for _, i, j in rows],
                         pa.binary()),
        "ids": pa.array([None if ids is None else pack(ids[i:j]) for _, i, j in rows],
                        pa.binary())})


def answer(phase: int, bucket: int, chunks: list[int], counts: list[int], found: np.ndarray,
           packed: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One reply per asking row, cut from `found` in the order of the rows."""
    cuts = np.cumsum([0, *counts])
    return pa.table({
        "chunk": pa.array(chunks, pa.int32()),
        "phase": pa.array([phase] * len(chunks), pa.int32()),
        "bucket": pa.array([bucket] * len(chunks), pa.int32()),
        "n": pa.array(counts, pa.int64()),
        "reply": pa.array([packed(found[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
                          pa.binary())})


def bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("chunk")


def recurring(phase: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Bucket task: for each key of each chunk, whether another chunk has it too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = ordered(table)
        each = [unpack_sorted(x.as_py()) for x in table["keys"]]
        keys = np.concatenate(each)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        found = np.zeros(len(keys), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        return answer(phase, key[0].as_py(), table["chunk"].to_pylist(), [len(x) for x in each],
                      found, bits)

    return run


def earlier(phase: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Bucket task: for each key of each chunk, whether another chunk has it with a smaller id."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = ordered(table)
        each = [unpack_sorted(x.as_py()) for x in table["keys"]]
        keys = np.concatenate(each)
        more = np.concatenate([unpack(x.as_py(), "<u4") for x in table["more"]])
        ids = np.concatenate([unpack(x.as_py(), "<i8") for x in table["ids"]])
        order = np.lexsort((ids, more, keys))
        k, m, i = keys[order], more[order], ids[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
        least = i[np.flatnonzero(first)][np.cumsum(first) - 1]
        found = np.zeros(len(k), bool)
        found[order] = least < i
        return answer(phase, key[0].as_py(), table["chunk"].to_pylist(), [len(x) for x in each],
                      found, bits)

    return run


def replies(table: pa.Table, phase: int) -> list[tuple[int, bytes]]:
    """Counts and payloads of a phase's replies to a chunk, in the order in which it asked."""
    rows = [(b, n, r) for p, b, n, r in zip(
        table["phase"].to_pylist(), table["bucket"].to_pylist(), table["n"].to_pylist(),
        table["reply"].to_pylist(), strict=True) if p == phase]
    return [(n, r) for _, n, r in sorted(rows)]


def reply_bits(table: pa.Table, phase: int) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(r, np.uint8), count=n).view(bool)
             for n, r in replies(table, phase)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def give_back() -> None:
    """Return freed memory to the system. Spark's Python workers outlive their tasks, and what they
    hold on to would be missing to the executor's later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    def wrapped(*args) -> pa.Table:
        try:
            return run(*args)
        finally:
            give_back()

    return wrapped


def by_chunk(df: DataFrame, asked: Callable[[int, Chunk], pa.Table], schema: str) -> DataFrame:
    """First phase: each chunk on its own."""
    one = tidy(lambda key, table: asked(key[0].as_py(), Chunk(table)))
    return df.groupBy("chunk").applyInArrow(lambda key, table: one(key, table), schema)


def by_bucket(asked: DataFrame, answered: Callable[[tuple, pa.Table], pa.Table]) -> DataFrame:
    """The answers to what all chunks asked, dealt back by chunk."""
    one = tidy(answered)
    return asked.groupBy("bucket").applyInArrow(lambda key, table: one(key, table), REPLY) \
        .repartition("chunk")


def with_replies(df: DataFrame, answers: list[DataFrame],
                 run: Callable[[int, Chunk, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Later phase: each chunk together with the replies that it has got so far."""
    got = answers[0]
    for a in answers[1:]:
        got = got.unionByName(a)
    one = tidy(lambda key, table, said: run(key[0].as_py(), Chunk(table), said))
    return df.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(
        lambda key, table, said: one(key, table, said), schema)


def runs(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of set flags; a run ends where a document does."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(flags) + 1, bool)
    cut[starts[starts < len(flags)]] = True
    padded = np.concatenate([[False], flags, [False]])
    up = padded[1:] & (~padded[:-1] | cut)
    down = padded[:-1] & (~padded[1:] | cut)
    return np.flatnonzero(up), np.flatnonzero(down)


def first_and_last(group: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of each of n groups."""
    low, high = np.full(n, LAST_ID), np.full(n, -(1 << 63))
    np.minimum.at(low, group, keys)
    np.maximum.at(high, group, keys)
    return low, high


def covered(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `size` places lie in one of the half-open intervals."""
    change = np.bincount(begins, minlength=size + 1).astype(np.int64)
    change -= np.bincount(ends, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


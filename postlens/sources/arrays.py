"""JSON arrays of any length, read by several tasks.

An array file has no line structure, and whether a byte is inside a string or how deep it is nested
depends on everything before it. So it is read twice:

1. Spark splits the file into blocks (the text source, cut after each `}`). A task works out what its
   block does to both possible states at its start: it either leaves quoting as it is or flips it, and
   changes the depth by one amount if it starts outside of strings and another if inside. These few
   numbers per block, put together along each file, give the state at which every block starts.
2. With that known, each block finds the commas between elements. Elements within a block are rows at
   once; the pieces at the edges are joined along the blocks that an element spans.

A file may also be one object, or objects one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Every object ends with it, so pieces are about as long as elements.
CUT = "}"
CHUNK_BYTES = 4 << 20

TEXT, LONG, FLAG = pa.string(), pa.int64(), pa.bool_()
STATES = pa.schema({"path": TEXT, "block": LONG, "flips": FLAG, "outside": LONG, "inside": LONG, "opens": TEXT}.items())
STARTS = pa.schema({"path": TEXT, "block": LONG, "quoted": FLAG, "depth": LONG, "array": FLAG}.items())
PIECES = pa.schema({"path": TEXT, "block": LONG, "part": LONG, "edge": TEXT, "text": TEXT}.items())
#: A piece that ends an element begun earlier, one that begins an element, a block inside one element.
TAIL, HEAD, MIDDLE, WHOLE = "tail", "head", "middle", "whole"

BLANK = b"\xef\xbb\xbf \t\r\n"
QUOTE, COMMA = ord('"'), ord(",")
STEP = np.zeros(256, np.int64)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1


def pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`path`, `block`, `value`; within a task the pieces of a block follow each other."""
    return spark.read.option("lineSep", CUT).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        "value")


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes | None]]:
    """The chunks of each block in turn, then None at its end."""
    at, parts, size = None, [], 0
    for batch in it:
        for path, block, value in zip(*(batch[c].to_pylist() for c in ("path", "block", "value")),
                                      strict=True):
            if at != (path, block):
                if at is not None:
                    yield *at, b"".join(parts)
                    yield *at, None
                at, parts, size = (path, block), [], 0
            parts += (value.encode(), b"}")
            size += len(value)
            if size >= CHUNK_BYTES:
                yield *at, b"".join(parts)
                parts, size = [], 0
    if at is not None:
        yield *at, b"".join(parts)
        yield *at, None


def scanned(chunk: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a chunk, whether each is inside of a string, and how the depth changes at it if it
    is not. A chunk ends after a `}`, so none starts within an escape."""
    data = np.frombuffer(chunk.replace(b"\\\\", b"  ").replace(b'\\"', b"  "), np.uint8)
    return data, (np.cumsum(data == QUOTE) + quoted) % 2 == 1, STEP[data]


def transitions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the state it starts in."""
    quoted, outside, inside, opens = False, 0, 0, None
    for path, block, chunk in blocks(it):
        if chunk is None:
            row = (path, block, quoted, outside, inside, opens)
            yield rows_of([row], STATES)
            quoted, outside, inside, opens = False, 0, 0, None
            continue
        opens = opens or chunk.lstrip(BLANK)[:1].decode("latin-1")
        # had the block started inside of a string, all that is outside now would be inside
        _, within, step = scanned(chunk, quoted)
        outside, inside = outside + int(step[~within].sum()), inside + int(step[within].sum())
        quoted = bool(within[-1])


def composed(table: pa.Table) -> pa.Table:
    """The state at the start of each block of a file."""
    rows = table.sort_by("block").to_pylist()
    quoted, depth, out = False, 0, []
    for r in rows:
        out.append((r["path"], r["block"], quoted, depth, rows[0]["opens"] == "["))
        depth += r["inside"] if quoted else r["outside"]
        quoted ^= r["flips"]
    return pa.Table.from_batches([rows_of(out, STARTS)])


@dataclass
class Cutter:
    """Cuts a block into its elements; `open` is what follows the last boundary."""

    quoted: bool
    depth: int
    array: bool
    #: Nothing but blanks follows the array.
    over: bool = False
    open: bytes = b""

    def cut(self, chunk: bytes) -> list[str]:
        """The texts that end at a boundary in this chunk."""
        if self.over:
            return []
        data, within, step = scanned(chunk, self.quoted)
        step = np.where(within, 0, step)
        depth = self.depth + np.cumsum(step)
        if self.array:
            # the bracket that opens the array, commas in it, and the bracket that closes it
            ends = (step == 1) & (depth == 1) | (data == COMMA) & ~within & (depth == 1) \
                | (step == -1) & (depth == 0)
        else:
            ends = (step == -1) & (depth == 0)
        out, last = [], 0
        for end in np.flatnonzero(ends).tolist():
            out.append((self.open + chunk[last:end + (not self.array)]).decode())
            self.open, last = b"", end + 1
            if self.array and depth[end] == 0:
                self.over = True
                return out
        self.open += chunk[last:]
        self.depth, self.quoted = int(depth[-1]), bool(within[-1])
        return out


def cut_blocks(it: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple]) -> Iterator[pa.RecordBatch]:
    cutter, rows, part, size = None, [], 0, 0
    for path, block, chunk in blocks(it):
        if cutter is None:
            quoted, depth, array = starts[path, block]
            cutter, part = Cutter(quoted, depth, array, over=array and block > 0 and depth <= 0), 0
        if chunk is not None:
            for text in cutter.cut(chunk):
                rows.append((path, block, part, TAIL if not part and block else WHOLE, text))
                part, size = part + 1, size + len(text)
        else:
            if not cutter.over:
                edge = HEAD if part or not block else MIDDLE
                rows.append((path, block, part, edge, cutter.open.decode()))
            cutter = None
        if size >= CHUNK_BYTES:
            yield rows_of(rows, PIECES)
            rows, size = [], 0
    if rows:
        yield rows_of(rows, PIECES)


def read_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`path`, `text` of every element of the arrays in `paths`, null elements left out.

    The states kept for all blocks are a few numbers for each of Spark's splits.
    """
    states = pieces(spark, paths).mapInArrow(transitions, from_arrow_schema(STATES)) \
        .groupBy("path").applyInArrow(composed, from_arrow_schema(STARTS)).collect()
    starts = {(r.path, r.block): (r.quoted, r.depth, r.array) for r in states}
    shared = spark.sparkContext.broadcast(starts)
    cut = pieces(spark, paths).mapInArrow(lambda it: cut_blocks(it, shared.value), from_arrow_schema(PIECES))
    along = Window.partitionBy("path").orderBy("block", "part")
    edges = cut.filter(F.col("edge") != WHOLE) \
        .withColumn("begins", F.when(F.col("edge") == HEAD, F.col("block")))
    # a text belongs to the block where its element begins; only edges are looked at here
    joined = edges.withColumn("begins", F.last("begins", ignorenulls=True).over(along)) \
        .groupBy("path", "begins").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    found = cut.filter(F.col("edge") == WHOLE).select("path", "text").unionByName(joined.select("path", "text"))
    text = F.regexp_replace("text", "^[\\ufeff\\s]+|\\s+$", "")
    # the text source does not tell that no brace follows the last piece of a file
    return found.select("path", text.alias("text")).filter(~F.col("text").isin("", "null", CUT))

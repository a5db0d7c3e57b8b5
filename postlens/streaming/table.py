"""A table with one row per key that batches are merged into.

Rows live in buckets by a hash of (some of) their key. A batch rewrites only the buckets it has rows
for, as files under its own id; the manifest of the batch, written last, says which batch's files each
bucket is in. So a batch that is killed leaves nothing that is read, one that is run again writes the
same, and one whose manifest is there is not applied a second time. Readers take the newest manifest
and are not disturbed by a merge.

A bucket should be worth a task: give about as many buckets as the table has hundreds of megabytes,
and `rebucket` when it has outgrown them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlens.session import names_in, read_note, remove, write_note

#: What a batch starts from where there is none yet.
NO_BATCH = -1


@dataclass(frozen=True)
class Manifest:
    batch: int
    buckets: int
    #: The folder, named after a batch, that has the files of each bucket with rows.
    written_by: dict[int, str]
    #: How often the table was written anew since that batch.
    step: int = 0

    @property
    def name(self) -> str:
        """Names sort as manifests were written."""
        return f"{self.batch:015d}-{self.step:05d}.json"


class KeyedTable:
    """`merge_rows` makes one row of those with equal keys, given a frame of rows whose column
    `bucket` belongs to the key; it is also applied to each batch before anything is read."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket_by: Sequence[str],
                 merge_rows: Callable[[DataFrame], DataFrame], buckets: int = 32):
        self.spark, self.path, self.schema = spark, path, schema
        self.bucket_by, self.merge_rows, self._buckets = list(bucket_by), merge_rows, buckets

    def manifest(self) -> Manifest:
        names = [n for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not names:
            return Manifest(NO_BATCH, self._buckets, {})
        note = json.loads(read_note(self.spark, f"{self.path}/manifest/{max(names)}"))
        written_by = {int(b): v for b, v in note["written_by"].items()}
        return Manifest(note["batch"], note["buckets"], written_by, note["step"])

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(buckets)).cast("int").alias("bucket")

    def _files(self, written_by: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(written_by.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, folder: str, after: Manifest) -> None:
        rows.select("bucket", *self.schema.names).write.mode("overwrite").partitionBy("bucket") \
            .parquet(f"{self.path}/data/{folder}")
        write_note(self.spark, f"{self.path}/manifest/{after.name}", json.dumps(asdict(after)))

    def merge(self, rows: DataFrame, batch: int) -> list[int]:
        """Merge a batch; returns the buckets that were rewritten. `rows` is read twice. Batches come
        in the order of their ids; one that was merged before changes nothing."""
        now = self.manifest()
        if batch <= now.batch:
            return []
        # a hot key is down to one row here, whatever the batch holds of it
        new = self.merge_rows(rows.select(self._bucket(now.buckets), *self.schema.names))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if touched:
            old = self._files({b: now.written_by[b] for b in touched if b in now.written_by})
            both = new.unionByName(old.select(self._bucket(now.buckets), *self.schema.names))
            # one task, and so one file, per bucket
            merged = self.merge_rows(both.repartition(len(touched), "bucket"))
            folder = f"batch={batch}"
            self._write(merged, folder, Manifest(
                batch, now.buckets, now.written_by | dict.fromkeys(touched, folder)))
        return touched

    def read(self) -> DataFrame:
        return self._files(self.manifest().written_by)

    def rebucket(self, buckets: int) -> None:
        """Write all rows anew in so many buckets. Not while batches are merged."""
        now = self.manifest()
        rows = self.read().select(self._bucket(buckets), *self.schema.names).repartition(buckets, "bucket")
        held = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        if held:
            folder = f"batch={now.batch}-{now.step + 1}"
            self._write(rows, folder, Manifest(now.batch, buckets, dict.fromkeys(held, folder), now.step + 1))

    def vacuum(self) -> int:
        """Remove what no bucket is read from any more, once no reader is left on an older manifest;
        returns how many bucket folders went."""
        now, gone = self.manifest(), 0
        for folder in names_in(self.spark, f"{self.path}/data"):
            read = {f"bucket={b}" for b, f in now.written_by.items() if f == folder}
            held = [n for n in names_in(self.spark, f"{self.path}/data/{folder}") if n.startswith("bucket=")]
            for name in held:
                if name not in read:
                    remove(self.spark, f"{self.path}/data/{folder}/{name}")
                    gone += 1
            if not read:
                remove(self.spark, f"{self.path}/data/{folder}")
        for name in names_in(self.spark, f"{self.path}/manifest"):
            if name != now.name:
                remove(self.spark, f"{self.path}/manifest/{name}")
        return gone

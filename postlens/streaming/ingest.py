"""Incremental ingest: landed postings, or landed responses of the services, into the clean table.

The row-local stages run on the stream. Keeping the longest copy across snapshots is not row-local:
each micro-batch is logged under its id and merged into the current table, a `KeyedTable` of which a
batch rewrites only the buckets it has postings for.

`collect` starts from the services' responses. One pass over a batch gives both its postings and the
responses that could not be read; both are logged by one write under the batch's id, the postings are
merged, and a commit note closes the batch. What has no note yet is not read, and a batch that is run
again after a failure replaces what it had written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from postlens import schemas
from postlens.operators.dedupe import keep_longest
from postlens.plans.wrangle import tag, to_clean
from postlens.session import names_in, read_note, write_note
from postlens.sources.payloads import normalise
from postlens.streaming.table import KeyedTable
from postlens.taxonomy import ROLE_SKILLS, Taxonomy

KEYS = ("company", "title")
CLEAN, QUARANTINE = "clean", "quarantine"


def read_landing_stream(spark: SparkSession, path: str, pattern: str = "*.json",
                        files_per_batch: int = 1000, multi_line: bool = True) -> DataFrame:
    return (
        spark.readStream.schema(schemas.RAW).option("multiLine", multi_line)
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def read_response_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Responses landed as JSON lines (`ENVELOPE`)."""
    return spark.readStream.schema(schemas.ENVELOPE).option("recursiveFileLookup", True) \
        .option("maxFilesPerTrigger", files_per_batch).json(path)


def posting_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    """The current table: of each posting the copy with the longest text."""
    return KeyedTable(spark, f"{path}/current", schemas.CLEAN, KEYS,
                      lambda rows: keep_longest(rows, ("bucket", *KEYS)), buckets)


def current_postings(spark: SparkSession, path: str) -> DataFrame:
    """The best copy of each posting over all batches."""
    return posting_table(spark, path).read()


def ingest(raw: DataFrame, path: str, checkpoint: str, taxonomy: Taxonomy = ROLE_SKILLS,
           buckets: int = 32) -> StreamingQuery:
    """Clean, tag and merge everything that has landed as raw postings, then stop."""
    table = posting_table(raw.sparkSession, path, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        # logged first, so the merge does not clean and tag twice
        log = f"{path}/log/batch={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        table.merge(batch.sparkSession.read.schema(schemas.CLEAN).parquet(log), batch_id)

    return (
        tag(to_clean(raw), taxonomy).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def sorted_out(responses: DataFrame, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """Clean, tagged postings and unreadable responses (`bad`) side by side; `output` says which. The
    same on a stream and on a table."""
    rows = tag(to_clean(normalise(responses), keep=["bad"]), taxonomy)
    return rows.withColumn("output", F.when(F.col("bad").isNull(), CLEAN).otherwise(QUARANTINE))


def postings_of(responses: DataFrame, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """Batch form: the clean table of a table of responses."""
    rows = sorted_out(responses, taxonomy).filter(F.col("output") == CLEAN)
    return keep_longest(rows.select(*schemas.CLEAN.names), KEYS)


def quarantine_of(responses: DataFrame) -> DataFrame:
    """Batch form: the responses that could not be read."""
    return normalise(responses).filter("bad IS NOT NULL").select("bad.*")


def collect(responses: DataFrame, path: str, checkpoint: str, taxonomy: Taxonomy = ROLE_SKILLS,
            buckets: int = 32) -> StreamingQuery:
    """Map, clean, tag and merge every response that has landed, set unreadable ones aside, then stop."""
    table = posting_table(responses.sparkSession, path, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, log = batch.sparkSession, f"{path}/log/batch={batch_id}"
        if batch_id in committed(spark, path):
            return
        batch.write.mode("overwrite").partitionBy("output").parquet(log)
        logged = spark.read.schema(batch.schema).parquet(log)
        clean = logged.filter(F.col("output") == CLEAN)
        rewritten = table.merge(clean.select(*schemas.CLEAN.names), batch_id)
        rows = {r["output"]: r["count"] for r in logged.groupBy("output").count().collect()}
        note = {"rows": rows, "buckets": len(rewritten)}
        write_note(spark, f"{path}/commits/{batch_id}.json", json.dumps(note))

    return (
        sorted_out(responses, taxonomy).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def committed(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches that are done."""
    return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{path}/commits")
                  if n.endswith(".json"))


def batch_notes(spark: SparkSession, path: str) -> dict[int, dict]:
    """Rows of each output, and buckets rewritten, by batch."""
    return {i: json.loads(read_note(spark, f"{path}/commits/{i}.json")) for i in committed(spark, path)}


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The responses that could not be read, of all batches that are done."""
    logs = [f"{path}/log/batch={i}" for i, note in batch_notes(spark, path).items()
            if note["rows"].get(QUARANTINE)]
    if not logs:
        return spark.createDataFrame([], schemas.QUARANTINE)
    schema = StructType([StructField("bad", schemas.QUARANTINE)])
    return spark.read.schema(schema).parquet(*(f"{log}/output={QUARANTINE}" for log in logs)) \
        .select("bad.*")

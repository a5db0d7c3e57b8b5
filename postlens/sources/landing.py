"""The landing folder of raw snapshots: read, count, write."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import schemas
from postlens.session import files_under, spread
from postlens.sources.arrays import read_elements


#: Array files from this size on are read by several tasks, at the price of reading them twice.
WHOLE_BYTES = 64 << 20


def read_landing(spark: SparkSession, path: str, pattern: str = "*.json",
                 multi_line: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """All raw postings under `path`, each file a JSON array. A folder without files gives no rows.

    Spark reads an array as one task. Those of `whole_bytes` and more are cut into their elements by
    `arrays`, block by block (values kept as JSON text lose their white space there); smaller ones are
    read whole. Snapshots kept as JSON lines
    (`multi_line=False`) split freely.
    """
    if multi_line:
        sizes = {f: n for f, n in files_under(spark, path).items() if fnmatch(f.rsplit("/", 1)[-1], pattern)}
        large = sorted(f for f, n in sizes.items() if n >= whole_bytes)
        if large:
            small = [f for f, n in sizes.items() if n < whole_bytes]
            parsed = F.from_json("text", schemas.RAW)
            rows = read_elements(spark, large).select(parsed.alias("r")).select("r.*")
            if small:
                rows = rows.unionByName(spread(
                    spark.read.schema(schemas.RAW).option("multiLine", True).json(small)))
            return rows
    try:
        return spread(
            spark.read.schema(schemas.RAW).option("multiLine", multi_line)
            .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.RAW)


def rows_per_file(spark: SparkSession, path: str, pattern: str = "*.json",
                  multi_line: bool = True) -> DataFrame:
    """(file, postings, path) for every file, including those that hold no posting."""
    loaded = (
        spark.read.schema(schemas.RAW).option("multiLine", multi_line)
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)
        .groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    )
    # only the path column is read, so no file is opened
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(path)
        .select(F.col("_metadata.file_path").alias("path"))
    )
    return listed.join(loaded, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.coalesce("n", F.lit(0)).alias("postings"), "path",
    )


def write_snapshot(df: DataFrame, path: str, collector: str, taken_at: Column,
                   fmt: str = "json") -> None:
    """Write one collector's run as its own partition; written again, it replaces that one only."""
    (
        df.withColumn("collector", F.lit(collector))
        .withColumn("snapshot_ts", F.date_format(taken_at, "yyyyMMdd_HHmmss"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collector", "snapshot_ts").format(fmt).save(path)
    )


def union_runs(*runs: tuple[str, DataFrame]) -> DataFrame:
    """Union of per-keyword results, each row tagged with its keyword; repeats are kept."""
    tagged = [df.withColumn("query", F.lit(keyword)) for keyword, df in runs]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged

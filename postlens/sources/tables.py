"""Clean and clustered tables: write as JSON or CSV, read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlens import schemas


class StageMissing(RuntimeError):
    """A table that an earlier job should have written is not there."""


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; arrays stay arrays and null keys are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, skills: str = "skills_extracted") -> None:
    """CSV with the skill array flattened to comma-joined text."""
    flat = df.withColumn(skills, F.array_join(skills, ", "))
    (
        flat.write.mode("overwrite").option("header", True).option("quote", '"')
        .option("escape", '"').option("emptyValue", "").csv(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType, made_by: str,
               fmt: str = "json") -> DataFrame:
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise StageMissing(f"{path} not found: run {made_by} first") from e


def read_clean(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, schemas.CLEAN, "postlens.plans.wrangle", fmt)


def read_clustered(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, schemas.CLUSTERED, "postlens.plans.clustering", fmt)

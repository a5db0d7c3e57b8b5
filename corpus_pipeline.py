"""From raw documents to packed training sequences.

Quality classifier, near-copy removal, repeated-string removal, benchmark decontamination, packing:
each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.catalog.registry import query
from postlens.llm import decontaminate, minhash, packing, quality, suffix_dedup
from postlens.llm.queries import table, tokenizer
from postlens.session import staging_root


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return minhash.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated byte strings. A character that a cut splits goes whole; a document of which
    nothing is left goes too, one that was empty before stays."""
    out = suffix_dedup.dedup(docs).where("n_removed = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.decode("text", "UTF-8")) \
        .otherwise(suffix_dedup.whole_characters(F.col("text")))
    changed = F.col("n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.length(text).cast("long"))
                          .otherwise(F.col("n_chars"))) \
        .withColumn("text", text).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in the training sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality_classifier", classify), ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats), ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@query(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)

"""Strip the intro that all postings of one company share.

A hash aggregate of fixed-width digests first drops every company whose postings do not all open with
the same `min_chars` characters. Only rows of the few companies left are looked at in full, where they
are: each task keeps the prefix that its rows of a company share, and sends that one string. The prefix
of all rows is the prefix of those, so no text is sorted or sent, and a company with a third of all
rows costs one row per task in either step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import strip_ends


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    differs_at = F.array_position(pairs, F.lit(False))
    return F.when(a == b, a).otherwise(F.left(a, (differs_at - 1).cast("int")))


def cut_back(prefix: Column) -> Column:
    """Drop everything from the last space on; unchanged without a space."""
    from_last_space = F.instr(F.reverse(prefix), F.lit(" "))
    return F.when(prefix.contains(" "), F.left(prefix, F.length(prefix) - from_last_space)) \
        .otherwise(prefix)


# Columns added by `with_heads`.
HEADS = ("_head", "_chars")


def with_heads(df: DataFrame, text: str = "description_clean", min_chars: int = 60) -> DataFrame:
    """Add a digest of the first `min_chars` characters and the length of the text."""
    return df.withColumns({"_head": F.xxhash64(F.left(text, F.lit(min_chars))),
                           "_chars": F.length(text)})


# Companies whose names are sent to all tasks; with more, rows and names are joined as Spark sees fit.
SENT = 500_000


def company_prefixes(df: DataFrame, company: str = "company", text: str = "description_clean",
                     min_rows: int = 2, min_chars: int = 60) -> DataFrame:
    """(company, rows, prefix) for companies whose postings share at least `min_chars` characters.

    The threshold is tested before the prefix is cut back to a whole word. A staged frame may bring
    the columns of `with_heads` for the same `min_chars` along.
    """
    if not set(HEADS) <= set(df.columns):
        df = with_heads(df, text, min_chars)
    rows = df.select(F.col(company).alias("company"), F.col(text).alias("_text"), *HEADS) \
        .filter(F.coalesce(F.col("company"), F.lit("")) != "")
    alike = (
        rows.groupBy("company")
        .agg(F.count("*").alias("rows"), F.min("_chars").alias("_shortest"),
             F.min("_head").alias("_low"), F.max("_head").alias("_high"))
        .filter((F.col("rows") >= min_rows) & (F.col("_shortest") >= min_chars)
                & (F.col("_low") == F.col("_high")))
        .select("company")
    )
    first = alike.limit(SENT + 1).toArrow()
    if len(first) <= SENT:
        alike = F.broadcast(df.sparkSession.createDataFrame(first))
    found = rows.select("company", "_text").join(alike, "company", "left_semi") \
        .mapInArrow(_shared, "company string, rows long, prefix string")
    return (
        found.groupBy("company")
        .agg(F.sum("rows").alias("rows"), F.min("prefix").alias("_low"), F.max("prefix").alias("_high"))
        .withColumn("prefix", common_prefix(F.col("_low"), F.col("_high")))
        .filter(F.length("prefix") >= min_chars)
        .select("company", "rows", cut_back(F.col("prefix")).alias("prefix"))
    )


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of each company in a task share, and how many there are."""
    prefix: dict[str, str] = {}
    rows: Counter[str] = Counter()
    for batch in it:
        for company, text in zip(batch["company"].to_pylist(), batch["_text"].to_pylist(), strict=True):
            rows[company] += 1
            known = prefix.get(company)
            if known is None:
                prefix[company] = text
            elif not text.startswith(known):
                prefix[company] = commonprefix([known, text])
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(prefix), pa.string()), pa.array([rows[c] for c in prefix], pa.int64()),
         pa.array(list(prefix.values()), pa.string())], names=["company", "rows", "prefix"])


def strip_prefixes(df: DataFrame, prefixes: DataFrame, company: str = "company",
                   text: str = "description_clean") -> DataFrame:
    """Remove each company's prefix from its rows. Only the prefix length is joined."""
    cuts = prefixes.select(F.col("company").alias("_company"), F.length("prefix").alias("_cut"))
    kept = strip_ends(F.substring(F.col(text), F.col("_cut") + 1, F.length(text)))
    return (
        df.join(cuts, F.col(company) == F.col("_company"), "left")
        .withColumn(text, F.when(F.col("_cut").isNotNull(), kept).otherwise(F.col(text)))
        .drop("_company", "_cut")
    )


def prefix_log(prefixes: DataFrame, sample_chars: int = 80) -> DataFrame:
    """(company, rows, sample): what was stripped, and from how many postings."""
    return prefixes.select("company", "rows", F.left("prefix", F.lit(sample_chars)).alias("sample"))

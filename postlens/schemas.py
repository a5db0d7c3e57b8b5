"""Declared schemas; nothing in this package infers one."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# `experience`, `location` and `skills` change JSON type from source to source. Declared as
# strings they hold the raw JSON text of whatever arrives.
RAW = T.StructType(
    _strings("source", "query", "job_id", "title", "company", "experience", "location",
             "description_snippet", "skills", "category")
    + [T.StructField("salary_min", T.DoubleType()), T.StructField("salary_max", T.DoubleType())]
    + _strings("posted_date", "url")
    + [T.StructField("scraped_at", T.TimestampType())]
)

# One response of a service, as landed.
ENVELOPE = T.StructType(
    _strings("service", "query", "payload") + [T.StructField("scraped_at", T.TimestampType())])

# A response that could not be read, and why.
QUARANTINE = T.StructType(
    _strings("service", "query") + [T.StructField("scraped_at", T.TimestampType())]
    + _strings("reason") + [T.StructField("keys", T.ArrayType(T.StringType()))] + _strings("payload"))

CLEAN = T.StructType(
    _strings("source", "search_query", "job_id", "title", "company", "location",
             "description_clean")
    + [T.StructField("description_is_truncated", T.BooleanType())]
    + _strings("posted_date", "url")
    + [
        T.StructField("skills_extracted", T.ArrayType(T.StringType())),
        T.StructField("skill_count", T.IntegerType()),
        T.StructField("exp_min_years", T.IntegerType()),
        T.StructField("exp_max_years", T.IntegerType()),
    ]
)

TREND = T.StructType([
    T.StructField("period", T.TimestampType()), T.StructField("skill", T.StringType()),
    T.StructField("postings", T.LongType())])

CLUSTERED = T.StructType(CLEAN.fields + [T.StructField("cluster", T.IntegerType())])

RESUME = T.StructType(_strings("resume_id", "text"))

PAIR = T.StructType(
    [T.StructField("pos", T.IntegerType())] + _strings("side", "skill")
)

TAXONOMY = T.StructType(_strings("skill", "category", "pattern", "kind"))

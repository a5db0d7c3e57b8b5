"""Payload mapping, landing folder, sinks and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import schemas
from postlens.catalog import checks, inputs
from postlens.catalog.registry import query
from postlens.catalog.text_queries import FLAT_SQL, flat, role_tagged
from postlens.session import new_folder
from postlens.sources import landing, payloads, tables
from postlens.streaming import ingest, trend

SEEN = "2026-07-11 09:05:07"
SEEN_SQL = f"TIMESTAMP '{SEEN}' AS scraped_at"
PAGE_SIZE = 20
SQL_TYPES = {"double": "DOUBLE", "timestamp": "TIMESTAMP"}


def _responses(spark: SparkSession, sf_dir: str, item: str, wrap: str) -> DataFrame:
    """Responses of up to 20 items each over all parts, shaped as the service would send them.

    Null fields are left out of the JSON, so these responses also have missing keys.
    """
    parts = inputs.table(spark, sf_dir, "part")
    page = F.floor(F.col("p_partkey") / PAGE_SIZE).alias("page")
    return (
        parts.groupBy(page).agg(F.collect_list(F.expr(item)).alias("items"))
        .select(F.concat(F.lit("page "), F.col("page")).alias("query"),
                F.lit(SEEN).cast("timestamp").alias("scraped_at"),
                F.when(F.col("page") % 10 == 3, F.lit('{"error": "limit", "code": 7}'))
                .otherwise(F.expr(f"to_json({wrap})")).alias("payload"))
    )


# Parts whose response arrived in the expected shape.
GOOD = f"""(SELECT *, 'page ' || (p_partkey // {PAGE_SIZE}) AS query, {SEEN_SQL} FROM part
  WHERE (p_partkey // {PAGE_SIZE}) % 10 <> 3)"""
PLACES = "'[{\"type\":\"location\",\"label\":\"' || p_type || '\"}]'"


def _raw_sql(**given: str) -> str:
    columns = []
    for f in schemas.RAW:
        kind = SQL_TYPES.get(f.dataType.simpleString(), "VARCHAR")
        value = given.get(f.name, f.name if f.name in ("query", "scraped_at") else "NULL")
        columns.append(f"CAST({value} AS {kind}) AS {f.name}")
    return f"SELECT {', '.join(columns)} FROM {GOOD}"


BOARD_ITEM = """named_struct(
  'jobId', p_partkey, 'title', p_name, 'companyName', p_brand,
  'footerPlaceholderLabel', case p_size % 3 when 0 then '' when 1 then concat(p_size, ' Yrs') end,
  'experienceText', concat('about ', p_size), 'location', p_type,
  'placeholders', case when p_size % 2 = 0 then
      array(named_struct('type', 'location', 'label', p_type)) end,
  'jobDescription', concat('<b>', p_name, '</b>'), 'tagsAndSkills', p_type,
  'footerLabel', case p_size % 4 when 0 then '' when 1 then 'Today' end, 'createdDate', '2026-07-01',
  'jdURL', case when p_size % 5 > 0 then concat('a/', p_partkey) end)"""


BOARD_RAW = _raw_sql(
    source="'naukri'", job_id="p_partkey", title="p_name", company="p_brand",
    experience="CASE WHEN p_size % 3 = 1 THEN p_size || ' Yrs' ELSE 'about ' || p_size END",
    location=f"CASE WHEN p_size % 2 = 0 THEN {PLACES} ELSE p_type END",
    description_snippet="'<b>' || p_name || '</b>'", skills="p_type",
    posted_date="CASE WHEN p_size % 4 = 1 THEN 'Today' ELSE '2026-07-01' END",
    url="'https://www.naukri.com/job-listings-' || CASE WHEN p_size % 5 > 0 THEN 'a/' || p_partkey "
        "ELSE p_partkey::VARCHAR END")


@query(BOARD_RAW)
def payload_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.normalise_board(
        _responses(spark, sf_dir, BOARD_ITEM, "named_struct('jobDetails', items)"))


LISTING_ITEM = """named_struct('id', cast(p_partkey as string), 'title', p_name,
  'company', case when p_size % 3 > 0 then named_struct('display_name', p_brand) end,
  'location', named_struct('display_name', p_type),
  'category', case when p_size % 4 > 0 then named_struct('label', p_type) end,
  'description', concat(p_name, ' …'), 'salary_min', p_retailprice,
  'salary_max', case when p_size % 2 = 0 then p_retailprice + 0.5 end,
  'created', '2026-07-01T00:00:00Z', 'redirect_url', concat('https://x.example/', p_partkey))"""


LISTING_RAW = _raw_sql(
    source="'adzuna'", job_id="p_partkey", title="p_name",
    company="CASE WHEN p_size % 3 > 0 THEN p_brand END", location="p_type",
    description_snippet="p_name || ' …'", category="CASE WHEN p_size % 4 > 0 THEN p_type END",
    salary_min="p_retailprice", salary_max="CASE WHEN p_size % 2 = 0 THEN p_retailprice + 0.5 END",
    posted_date="'2026-07-01T00:00:00Z'", url="'https://x.example/' || p_partkey")


@query(LISTING_RAW)
def payload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.normalise_listing(
        _responses(spark, sf_dir, LISTING_ITEM, "named_struct('results', items)"))


SEARCH_ITEM = """named_struct(
  'job_publisher', case when p_size % 3 > 0 then p_type end, 'job_id', cast(p_partkey as string),
  'job_title', p_name, 'employer_name', p_brand,
  'job_required_experience', case when p_size % 4 > 0 then
      named_struct('required_experience_in_months', p_size * 12) end,
  'job_city', case p_size % 3 when 0 then '' when 1 then p_type end, 'job_country', 'IN',
  'job_description', p_name, 'job_required_skills', array(p_type, p_brand),
  'job_posted_at_datetime_utc', '2026-07-01T00:00:00Z', 'job_apply_link', 'https://y.example/')"""


SEARCH_RAW = _raw_sql(
    source="CASE WHEN p_size % 3 > 0 THEN p_type ELSE 'jsearch' END", job_id="p_partkey",
    title="p_name", company="p_brand",
    experience="CASE WHEN p_size % 4 > 0 THEN p_size * 12 END",
    location="CASE WHEN p_size % 3 = 1 THEN p_type ELSE 'IN' END", description_snippet="p_name",
    skills="""'["' || p_type || '","' || p_brand || '"]'""",
    posted_date="'2026-07-01T00:00:00Z'", url="'https://y.example/'")


@query(SEARCH_RAW)
def payload_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrap = "named_struct('data', named_struct('jobs', items))"
    return payloads.normalise_search(_responses(spark, sf_dir, SEARCH_ITEM, wrap))


@query(f"""SELECT DISTINCT 'page ' || (p_partkey // {PAGE_SIZE}) AS query, {SEEN_SQL},
  'error|code' AS keys FROM part WHERE (p_partkey // {PAGE_SIZE}) % 10 = 3""")
def payload_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir, BOARD_ITEM, "named_struct('jobDetails', items)")
    return payloads.bad_payloads(rows, "jobDetails").withColumn("keys", F.array_join("keys", "|"))


@query(f"""WITH raw AS ({inputs.ROLE_SQL}) SELECT * REPLACE ('first' AS query) FROM raw
  UNION ALL SELECT * REPLACE ('second' AS query, NULL AS experience) FROM raw""")
def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.role_postings(spark, sf_dir)
    return landing.union_runs(("first", rows), ("second", rows.drop("experience")))


#: What role postings lack of the raw schema, so that each column holds something.
MORE_RAW = {
    "experience": "case when length(title) % 3 = 0 then concat(length(title), ' Yrs') end",
    "skills": "concat('[\"', source, '\"]')", "category": "query",
    "salary_min": "length(title) + 0.5", "salary_max": "case when length(title) % 2 = 0 then 1e6 end",
    "scraped_at": f"cast('{SEEN}' as timestamp)",
}
RAW_SQL = ", ".join(f"CAST({MORE_RAW.get(f.name, f.name)} AS {SQL_TYPES.get(f.dataType.simpleString(), 'VARCHAR')})"
                    f" AS {f.name}" for f in schemas.RAW)


def _as_raw(df: DataFrame) -> DataFrame:
    return df.select(*[F.expr(MORE_RAW.get(f.name, f.name)).cast(f.dataType).alias(f.name)
                       for f in schemas.RAW])


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Role postings written as snapshots of two collectors."""
    folder = new_folder(spark, "landing")
    rows = _as_raw(inputs.role_postings(spark, sf_dir))
    at = F.lit(SEEN).cast("timestamp")
    landing.write_snapshot(rows.filter(F.col("source") == "board"), folder, "board", at)
    landing.write_snapshot(rows.filter(F.col("source") != "board"), folder, "other", at)
    return folder


@query(f"WITH raw AS ({inputs.ROLE_SQL}) SELECT {RAW_SQL} FROM raw")
def landing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.read_landing(spark, _landed(spark, sf_dir), multi_line=False).select(*schemas.RAW.names)


@query(f"""WITH raw AS ({inputs.ROLE_SQL}) SELECT CASE WHEN source = 'board' THEN 'board' ELSE 'other'
  END AS collector, count(*) AS postings FROM raw GROUP BY ALL""")
def landing_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per file depend on how Spark split the write, so they are added up by collector."""
    files = landing.rows_per_file(spark, _landed(spark, sf_dir), multi_line=False)
    collector = F.regexp_extract("path", "collector=([^/]*)", 1)
    return files.groupBy(collector.alias("collector")).agg(F.sum("postings").alias("postings"))


#: Postings of one array file.
ARRAY_ROWS = 500


def _array_files(spark: SparkSession, sf_dir: str) -> str:
    """Role postings as JSON arrays of bounded length, one per file, and a file with an empty one."""
    folder = new_folder(spark, "arrays")
    rows = _as_raw(inputs.role_postings(spark, sf_dir)) \
        .withColumn("batch", F.expr(f"cast(job_id as bigint) div {ARRAY_ROWS}"))
    fields = F.struct(*(f.name for f in schemas.RAW))
    rows.groupBy("batch").agg(F.to_json(F.collect_list(fields)).alias("value")) \
        .unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("batch"),
                                           F.lit("[]").alias("value"))) \
        .write.partitionBy("batch").text(folder)
    return folder


@query(f"WITH raw AS ({inputs.ROLE_SQL}) SELECT {RAW_SQL} FROM raw")
def landing_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.read_landing(spark, _array_files(spark, sf_dir), "*.txt").select(*schemas.RAW.names)


def _join_files(it: Iterator[pa.RecordBatch], parts: str, folder: str) -> Iterator[pa.RecordBatch]:
    """The files that Spark wrote to `parts`, in order, as one file in `folder`."""
    for batch in it:
        if len(batch):
            (store, source), (_, target) = map(fs.FileSystem.from_uri, (parts, folder))
            store.create_dir(target, recursive=True)
            names = sorted(f.path for f in store.get_file_info(fs.FileSelector(source))
                           if f.base_name.startswith("part-"))
            with store.open_output_stream(f"{target}/all.txt") as out:
                for name in names:
                    with store.open_input_stream(name) as file:
                        while data := file.read(1 << 20):
                            out.write(data)
        yield batch


def _one_array(spark: SparkSession, sf_dir: str) -> str:
    """All role postings as one JSON array in one file, whose last element is null. Ranges of them are
    sorted and written by a task each; the one that puts these files together holds a piece at a time."""
    parts, folder = new_folder(spark, "array-parts"), new_folder(spark, "one-array")
    rows = _as_raw(inputs.role_postings(spark, sf_dir))
    lines = rows.select(F.col("job_id").cast("long").alias("at"), F.concat(
        F.to_json(F.struct(*(f.name for f in schemas.RAW))), F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(-1, "["), (1 << 62, "null ]")], "at long, value string")
    lines.unionByName(ends).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(parts)
    spark.range(1).mapInArrow(lambda it: _join_files(it, parts, folder), "id long").count()
    return folder


@query(f"WITH raw AS ({inputs.ROLE_SQL}) SELECT {RAW_SQL} FROM raw")
def landing_large_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array file cut into its elements by several tasks."""
    rows = landing.read_landing(spark, _one_array(spark, sf_dir), "*.txt", whole_bytes=0)
    return rows.select(*schemas.RAW.names)


@query(f"""SELECT count(*) AS files, sum(n)::BIGINT AS postings, count_if(n = 0)::BIGINT AS empty FROM (
  SELECT count(*) AS n FROM part GROUP BY p_partkey // {ARRAY_ROWS} UNION ALL SELECT 0)""")
def landing_array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = landing.rows_per_file(spark, _array_files(spark, sf_dir), "*.txt")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("postings").alias("postings"),
                     F.count_if(F.col("postings") == 0).alias("empty"))


@query(f"""WITH raw AS ({inputs.ROLE_SQL}) SELECT 'full' AS folder, count(*) AS postings FROM raw
  UNION ALL SELECT 'no such file', 0 UNION ALL SELECT 'no such folder', 0""")
def landing_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder without files, and one that is not there, give no rows and no error."""
    folder = _landed(spark, sf_dir)
    read = {
        "full": landing.read_landing(spark, folder, multi_line=False),
        "no such file": landing.read_landing(spark, folder, "*.none"),
        "no such folder": landing.read_landing(spark, f"{folder}/none"),
    }
    out = None
    for name, rows in read.items():
        count = rows.agg(F.count("*").alias("postings")).select(F.lit(name).alias("folder"), "postings")
        out = count if out is None else out.unionByName(count)
    return out


@query(f"{checks.ROLE_TAGGED} SELECT {FLAT_SQL} FROM t")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "clean-json")
    tables.write_json(role_tagged(spark, sf_dir), folder)
    return flat(tables.read_clean(spark, folder))


@query(f"{checks.ROLE_TAGGED} SELECT {FLAT_SQL}, length(title)::INTEGER AS cluster FROM t")
def clustered_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "clustered")
    tables.write_json(role_tagged(spark, sf_dir).withColumn("cluster", F.length("title")), folder)
    return flat(tables.read_clustered(spark, folder))


@query(f"""{checks.ROLE_TAGGED} SELECT * REPLACE (array_to_string(skills_extracted, ', ') AS skills_extracted,
  CAST(skill_count AS BIGINT) AS skill_count) FROM t""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "clean-csv")
    tables.write_csv(role_tagged(spark, sf_dir), folder)
    kinds = {"skills_extracted": "string"}
    schema = ", ".join(f"{f.name} {kinds.get(f.name, f.dataType.simpleString())}" for f in schemas.CLEAN)
    return (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(schema)
        .csv(folder).fillna("", ["skills_extracted", "description_clean"])
        .withColumn("skill_count", F.col("skill_count").cast("bigint"))
    )


@query(f"""{checks.ROLE_TAGGED} SELECT {FLAT_SQL} FROM (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY company, title ORDER BY length(description_clean) DESC,
  job_id, url, source) AS rn FROM t) WHERE rn = 1)""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over landed snapshots ends at the table the batch stages give."""
    path, state = new_folder(spark, "ingest"), new_folder(spark, "state")
    raw = ingest.read_landing_stream(spark, _landed(spark, sf_dir), files_per_batch=8,
                                     multi_line=False)
    ingest.ingest(raw, path, state, buckets=4).awaitTermination()
    return flat(ingest.current_postings(spark, path))


#: Every part comes from one of three services; a tenth of the pages is an error message, and two
#: further responses belong to no service or are cut off.
MIXED = {"naukri": (BOARD_ITEM, "named_struct('jobDetails', items)"),
         "adzuna": (LISTING_ITEM, "named_struct('results', items)"),
         "jsearch": (SEARCH_ITEM, "named_struct('data', named_struct('jobs', items))")}
ERROR = '{"error": "limit", "code": 7}'


def _mixed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for i, (name, (item, wrap)) in enumerate(MIXED.items()):
        rows = _responses(spark, sf_dir, item, wrap) \
            .filter(F.expr(f"cast(substring(query, 6) as bigint) % 3 = {i}")) \
            .withColumn("service", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    page = F.expr("cast(substring(query, 6) as bigint)")
    odd = out.filter(page % 7 == 0)
    out = out.unionByName(odd.withColumn("service", F.lit("other"))) \
        .unionByName(odd.withColumn("payload", F.expr("left(payload, length(payload) - 1)")))
    return out.select(*schemas.ENVELOPE.names)


def _landed_responses(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "responses")
    _mixed_responses(spark, sf_dir).repartition(6, "service", "query").write.json(folder)
    return folder


PAGE = f"(p_partkey // {PAGE_SIZE})"
SERVICE_RAW = " UNION ALL ".join(
    f"SELECT * FROM ({sql}) WHERE CAST(substr(query, 6) AS BIGINT) % 3 = {i}" for i, sql in enumerate(
        (BOARD_RAW, LISTING_RAW, SEARCH_RAW)))
COLLECTED = f"""WITH raw AS ({SERVICE_RAW}), cleaned AS (
  SELECT source, query AS search_query, job_id, coalesce(title, '') AS title, company, location,
    {checks.clean_sql("description_snippet")} AS description_clean,
    {checks.truncated_sql("description_snippet")} AS description_is_truncated, posted_date, url FROM raw),
t AS ({checks.tagged_sql("cleaned")})
SELECT {FLAT_SQL} FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company,
  title ORDER BY length(description_clean) DESC, job_id, url, source) AS rn FROM t) WHERE rn = 1)"""


@query(COLLECTED)
def collect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of three services to the clean table, as a stream."""
    path, state = new_folder(spark, "collected"), new_folder(spark, "state")
    responses = ingest.read_response_stream(spark, _landed_responses(spark, sf_dir), files_per_batch=3)
    ingest.collect(responses, path, state, buckets=4).awaitTermination()
    return flat(ingest.current_postings(spark, path))


@query(COLLECTED)
def collect_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of responses."""
    return flat(ingest.postings_of(_mixed_responses(spark, sf_dir)))


BAD = f"""WITH pages AS (SELECT DISTINCT {PAGE} AS page FROM part),
  given AS (SELECT page, ['naukri', 'adzuna', 'jsearch'][page % 3 + 1] AS service,
    page % 10 = 3 AS failed FROM pages),
  rows_ AS (SELECT *, CASE WHEN failed AND service <> 'jsearch' THEN 'no list of postings' END AS reason FROM given
    UNION ALL SELECT page, 'other', failed, 'unknown service' FROM given WHERE page % 7 = 0
    UNION ALL SELECT page, service, failed, 'not a JSON object' FROM given WHERE page % 7 = 0)
SELECT service, 'page ' || page AS query, {SEEN_SQL}, reason, CASE WHEN reason = 'not a JSON object' THEN ''
  WHEN failed THEN 'error|code' WHEN service <> 'other' THEN '?' ELSE ['jobDetails', 'results', 'data'][page % 3 + 1]
  END AS keys, CASE WHEN failed AND reason = 'not a JSON object' THEN '{ERROR[:-1]}' WHEN failed THEN '{ERROR}' END
  AS error FROM rows_ WHERE reason IS NOT NULL"""


def _set_aside(df: DataFrame) -> DataFrame:
    """Quarantine in comparable form; whole payloads are compared where they are error messages."""
    return df.select("service", "query", "scraped_at", "reason", F.array_join("keys", "|").alias("keys"),
                     F.when(F.col("payload").startswith('{"error"'), F.col("payload")).alias("error"))


@query(BAD)
def collect_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream sets aside."""
    path, state = new_folder(spark, "collected"), new_folder(spark, "state")
    responses = ingest.read_response_stream(spark, _landed_responses(spark, sf_dir), files_per_batch=3)
    ingest.collect(responses, path, state, buckets=4).awaitTermination()
    return _set_aside(ingest.quarantined(spark, path))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in three landed parts, the first months last, one part a batch."""
    folder = new_folder(spark, "events")
    part = F.pmod(F.dayofyear("scraped_at"), F.lit(3)).alias("part")
    events = inputs.table(spark, sf_dir, "events").select(
        F.col("ts").alias("scraped_at"), F.array("event_type").alias("skills_extracted"))
    events.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(folder)
    return (
        spark.readStream.schema("scraped_at timestamp, skills_extracted array<string>")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def _running(spark: SparkSession, sf_dir: str, counts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    table = trend.trend_table(spark, new_folder(spark, "trend"), 4)
    trend.running_trend(_event_stream(spark, sf_dir), table, new_folder(spark, "state"), counts) \
        .awaitTermination()
    return table.read()


@query("""SELECT date_trunc('month', ts)::TIMESTAMP AS period, event_type AS skill,
  count(*) AS postings FROM events GROUP BY ALL""")
def stream_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir, trend.period_counts)


@query("""SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS period,
  event_type AS skill, count(*) AS postings FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir, trend.window_counts)

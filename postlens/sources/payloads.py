"""Bring the response payloads of three posting services into the raw schema.

Input frames hold one response per row: `query`, `payload` (JSON text) and `scraped_at`. Items are
first taken as raw JSON text, since some defaults depend on whether a key is present at all and a
typed struct cannot tell a missing key from a null one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import schemas

# Source names and the link prefix of the first service.
BOARD_SOURCE = "naukri"
BOARD_LINK = "https://www.naukri.com/job-listings-"
LISTING_SOURCE = "adzuna"
SEARCH_SOURCE = "jsearch"

BOARD_ITEM = """jobId string, title string, companyName string, footerPlaceholderLabel string,
    experienceText string, placeholders string, location string, jobDescription string,
    tagsAndSkills string, footerLabel string, createdDate string, jdURL string"""
LISTING_ITEM = """id string, title string, company struct<display_name: string>,
    location struct<display_name: string>, category struct<label: string>, description string,
    salary_min double, salary_max double, created string, redirect_url string"""
SEARCH_ITEM = """job_publisher string, job_id string, job_title string, employer_name string,
    job_required_experience struct<required_experience_in_months: string>, job_city string,
    job_country string, job_description string, job_required_skills string,
    job_posted_at_datetime_utc string, job_apply_link string"""


def _filled(first: Column, second: Column) -> Column:
    """`first` unless it is null or empty, then `second` as it is."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def _has(key: str) -> Column:
    return F.array_contains(F.json_object_keys("item"), key)


def _listed(shape: str, field: str) -> Column:
    """The items of a payload as raw JSON texts; null where it has no such list."""
    parsed = F.from_json("payload", shape)
    for name in field.split("."):
        parsed = parsed.getField(name)
    return parsed


def _items(df: DataFrame, service: Service) -> DataFrame:
    return (
        df.select("query", "scraped_at", F.explode(_listed(service.shape, service.field)).alias("item"))
        .withColumn("j", F.from_json("item", service.item))
    )


def _raw(df: DataFrame, service: Service) -> DataFrame:
    """Select the raw schema, null where a service has no such field."""
    given = dict(service.columns("j"), query=F.col("query"), scraped_at=F.col("scraped_at"))
    return df.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RAW])


def _board(j: str) -> dict[str, Column]:
    link_id = (
        F.when(_has("jdURL"), F.coalesce(f"{j}.jdURL", F.lit("None")))
        .when(_has("jobId"), F.coalesce(f"{j}.jobId", F.lit("None"))).otherwise(F.lit(""))
    )
    return dict(
        source=F.lit(BOARD_SOURCE), job_id=F.col(f"{j}.jobId"), title=F.col(f"{j}.title"),
        company=F.col(f"{j}.companyName"),
        experience=_filled(F.col(f"{j}.footerPlaceholderLabel"), F.col(f"{j}.experienceText")),
        location=F.when(_has("placeholders"), F.col(f"{j}.placeholders"))
        .otherwise(F.col(f"{j}.location")),
        description_snippet=F.col(f"{j}.jobDescription"), skills=F.col(f"{j}.tagsAndSkills"),
        posted_date=_filled(F.col(f"{j}.footerLabel"), F.col(f"{j}.createdDate")),
        url=F.concat(F.lit(BOARD_LINK), link_id))


def _listing(j: str) -> dict[str, Column]:
    return dict(
        source=F.lit(LISTING_SOURCE), job_id=F.col(f"{j}.id"), title=F.col(f"{j}.title"),
        company=F.col(f"{j}.company.display_name"), location=F.col(f"{j}.location.display_name"),
        description_snippet=F.col(f"{j}.description"), category=F.col(f"{j}.category.label"),
        salary_min=F.col(f"{j}.salary_min"), salary_max=F.col(f"{j}.salary_max"),
        posted_date=F.col(f"{j}.created"), url=F.col(f"{j}.redirect_url"))


def _search(j: str) -> dict[str, Column]:
    return dict(
        source=F.when(_has("job_publisher"), F.col(f"{j}.job_publisher"))
        .otherwise(F.lit(SEARCH_SOURCE)),
        job_id=F.col(f"{j}.job_id"), title=F.col(f"{j}.job_title"), company=F.col(f"{j}.employer_name"),
        experience=F.col(f"{j}.job_required_experience.required_experience_in_months"),
        location=_filled(F.col(f"{j}.job_city"), F.col(f"{j}.job_country")),
        description_snippet=F.col(f"{j}.job_description"), skills=F.col(f"{j}.job_required_skills"),
        posted_date=F.col(f"{j}.job_posted_at_datetime_utc"), url=F.col(f"{j}.job_apply_link"))


@dataclass(frozen=True)
class Service:
    """Where a service's payload has its items, and how an item maps to the raw schema."""

    shape: str
    field: str
    item: str
    columns: Callable[[str], dict[str, Column]]
    #: Whether a payload without the list is an error rather than an answer without items.
    list_required: bool = True


SERVICES = {
    BOARD_SOURCE: Service("jobDetails array<string>", "jobDetails", BOARD_ITEM, _board),
    LISTING_SOURCE: Service("results array<string>", "results", LISTING_ITEM, _listing),
    SEARCH_SOURCE: Service("data struct<jobs: array<string>>", "data.jobs", SEARCH_ITEM, _search,
                           list_required=False),
}


def normalise_board(df: DataFrame) -> DataFrame:
    """{jobDetails: [...]}"""
    return _raw(_items(df, SERVICES[BOARD_SOURCE]), SERVICES[BOARD_SOURCE])


def normalise_listing(df: DataFrame) -> DataFrame:
    """{results: [...]} with nested company, location and category."""
    return _raw(_items(df, SERVICES[LISTING_SOURCE]), SERVICES[LISTING_SOURCE])


def normalise_search(df: DataFrame) -> DataFrame:
    """{data: {jobs: [...]}}; a missing level gives no rows."""
    return _raw(_items(df, SERVICES[SEARCH_SOURCE]), SERVICES[SEARCH_SOURCE])


def normalise(envelopes: DataFrame) -> DataFrame:
    """Responses of all services (`ENVELOPE`) to raw postings, in one narrow pass.

    A row either has the raw columns and a null `bad`, or is a response that could not be read:
    `bad` then holds it whole with the reason (a service that is not known, text that is no JSON
    object, an answer without its list) and the top-level keys it does have. Null items and answers
    with an empty list give no row.
    """
    service = F.col("service")

    def by_service(value: Callable[[str], Column]) -> Column:
        names = iter(SERVICES)
        out = F.when(service == (first := next(names)), value(first))
        for name in names:
            out = out.when(service == name, value(name))
        return out

    keys = F.json_object_keys("payload")
    required = [name for name, s in SERVICES.items() if s.list_required]
    reason = (
        F.when(~F.coalesce(service.isin(*SERVICES), F.lit(False)), "unknown service")
        .when(F.col("keys").isNull(), "not a JSON object")
        .when(service.isin(*required) & F.col("items").isNull(), "no list of postings")
    )
    listed = by_service(lambda name: _listed(SERVICES[name].shape, SERVICES[name].field))
    rows = (
        envelopes.withColumn("items", listed).withColumn("keys", keys).withColumn("reason", reason)
        .select("service", "query", "payload", "scraped_at", "reason", "keys",
                F.explode_outer("items").alias("item"))
        .filter("item IS NOT NULL OR reason IS NOT NULL")
    )
    for i, (name, s) in enumerate(SERVICES.items()):
        rows = rows.withColumn(f"j{i}", F.when(service == name, F.from_json("item", s.item)))
    mapped = {name: dict(s.columns(f"j{i}"), query=F.col("query"), scraped_at=F.col("scraped_at"))
              for i, (name, s) in enumerate(SERVICES.items())}
    good = F.col("reason").isNull()
    columns = [
        F.when(good, by_service(lambda name, f=f: mapped[name].get(f.name, F.lit(None)).cast(f.dataType)))
        .cast(f.dataType).alias(f.name) for f in schemas.RAW]
    bad = F.struct("service", "query", "scraped_at", "reason",
                   F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "payload")
    return rows.select(*columns, F.when(~good, bad).alias("bad"))


def bad_payloads(df: DataFrame, field: str) -> DataFrame:
    """Responses without the expected list, with the top-level keys they do have."""
    found = F.from_json("payload", f"{field} array<string>").getField(field)
    return df.filter(found.isNull()).select("query", "scraped_at", F.coalesce(
        F.json_object_keys("payload"), F.array().cast("array<string>")).alias("keys"))

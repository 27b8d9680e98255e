"""Postings of board B, out of JSON documents embedded in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions import addresses, dates, markup

# In (?d) mode '.' stops at line feeds only, and the lazy match ends at the first '};'.
_LINE_MODE = "(?d)"

_RESULTS_TYPE = (
    "struct<metaData:struct<mosaicProviderJobCardsModel:"
    "struct<results:array<string>,tierSummaries:array<string>>>>"
)
_RESULT_TYPE = (
    "struct<displayTitle:string,company:string,formattedLocation:string,pubDate:bigint,"
    "jobTypes:array<string>,"
    "jobSeekerMatchSummaryModel:struct<sortedMisMatchingEntityDisplayText:array<string>>,"
    "extractedSalary:struct<min:string,max:string,type:string>,"
    "jobkey:string,indeedApplyEnabled:boolean>"
)
_DETAIL_TYPE = "struct<jobInfoWrapperModel:struct<jobInfoModel:struct<sanitizedJobDescription:string>>>"


def embedded_model(html: Column) -> Column:
    """struct(results, tierSummaries) with each entry as JSON text; null when unreadable."""
    blob = F.regexp_extract(html, _LINE_MODE + fixed.RESULTS_BLOB, 1)
    return F.from_json(blob, _RESULTS_TYPE)["metaData"]["mosaicProviderJobCardsModel"]


def page_results(pages: DataFrame, html: str = "html") -> DataFrame:
    """Search pages with `results` and `tiers` in place of html."""
    return (
        pages.withColumn("_model", embedded_model(F.col(html)))
        .withColumns({"results": F.col("_model.results"), "tiers": F.col("_model.tierSummaries")})
        .drop("_model", html)
    )


def embedded_results(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per result, pages without a readable result list), after page_results."""
    keep = [c for c in pages.columns if c not in ("results", "tiers")]
    readable = F.col("results").isNotNull() & F.col("tiers").isNotNull()
    rows = pages.filter(readable).select(*keep, F.posexplode("results").alias("card", "result"))
    failing = pages.filter(~readable).select(*keep, F.lit("no readable result list").alias("reason"))
    return rows, failing


def embedded_tiers(pages: DataFrame) -> DataFrame:
    """One row per tier summary, after page_results."""
    keep = [c for c in pages.columns if c not in ("results", "tiers")]
    return pages.select(*keep, F.posexplode("tiers").alias("tier_no", "tier"))


def embedded_detail(html: Column) -> Column:
    """Clean description text out of a detail page; null when unreadable."""
    blob = F.regexp_extract(html, _LINE_MODE + fixed.DETAIL_BLOB, 1)
    detail = F.from_json(blob, _DETAIL_TYPE)["jobInfoWrapperModel"]["jobInfoModel"]
    return markup.html_to_text(detail["sanitizedJobDescription"])


def posting_from_json(
    results: DataFrame, as_of, base_url: str = fixed.BOARD_B_BASE_URL, result: str = "result"
) -> DataFrame:
    """Raw results as postings with a `reason` where a mandatory field is missing."""
    keep = [c for c in results.columns if c != result]
    raw = F.col("_r")
    salary = raw["extractedSalary"]
    skills = raw["jobSeekerMatchSummaryModel"]["sortedMisMatchingEntityDisplayText"]
    salary_complete = salary["min"].isNotNull() & salary["max"].isNotNull() & salary["type"].isNotNull()
    mandatory = {
        "displayTitle": raw["displayTitle"],
        "company": raw["company"],
        "formattedLocation": raw["formattedLocation"],
        "pubDate": raw["pubDate"],
        "sortedMisMatchingEntityDisplayText": skills,
        "jobkey": raw["jobkey"],
        "indeedApplyEnabled": raw["indeedApplyEnabled"],
    }
    reason = F.coalesce(
        *[F.when(value.isNull(), F.lit(f"no {name}")) for name, value in mandatory.items()],
        F.when(salary.isNotNull() & ~salary_complete, F.lit("incomplete salary")),
    )
    return results.withColumn("_r", F.from_json(F.col(result), _RESULT_TYPE)).select(
        *keep,
        raw["displayTitle"].alias("title"),
        addresses.board_b_detail_url(raw["jobkey"], base_url).alias("url"),
        raw["company"].alias("company"),
        raw["formattedLocation"].alias("location"),
        dates.epoch_millis(raw["pubDate"]).alias("posted_time"),
        F.when(raw["jobTypes"].isNotNull(), F.array_join(raw["jobTypes"], ", ")).alias("employment_type"),
        skills.alias("technologies_required"),
        F.when(
            salary_complete,
            F.concat(salary["min"], F.lit(" - "), salary["max"], F.lit(" "), salary["type"]),
        ).alias("salary_text"),
        raw["jobkey"].alias("job_id"),
        F.when(raw["indeedApplyEnabled"], "Yes").otherwise("No").alias("easy_apply"),
        dates.as_timestamp(as_of).alias("date_analyzed"),
        F.lit(fixed.SOURCE_B).alias("source"),
        reason.alias("reason"),
    )

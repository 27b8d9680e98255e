"""Row filters and the split of rows that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import as_timestamp


def valid_link_filter(cards: DataFrame, url: str = "url") -> DataFrame:
    return cards.filter(F.col(url) != "")


def quarantine_split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(usable rows, failing rows with the first reason). A failing row never stops a job."""
    reason = F.coalesce(*[
        F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks.items()
    ])
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def posting_predicates(
    postings: DataFrame,
    as_of=None,
    max_age_seconds: int | None = None,
    max_age_days: int | None = None,
    easy_apply: bool = False,
    seniority: list[str] | None = None,
    locations: list[str] | None = None,
) -> DataFrame:
    """Search constraints as plain predicates, so that they reach the scan."""
    if max_age_days is not None:
        days = max_age_days * 86_400
        max_age_seconds = days if max_age_seconds is None else min(days, max_age_seconds)
    if max_age_seconds is not None:
        oldest = as_timestamp(as_of) - F.make_interval(secs=F.lit(max_age_seconds))
        postings = postings.filter(F.col("posted_time") >= oldest)
    if easy_apply:
        postings = postings.filter(F.col("easy_apply") == "Yes")
    if seniority:
        postings = postings.filter(F.col("seniority_level").isin(seniority))
    if locations:
        postings = postings.filter(F.col("location").isin(locations))
    return postings

"""Not-modified revisits resolved to the latest earlier full response of the same page.

The as-of join runs in two levels, so that a url with a third of all captures is not one
task's work. Captures are cut by canonical url and span of time; inside a span a window finds
the last response before each revisit, and a window over one row per url and span carries the
last response of earlier spans on. Only ids and times take part; the response's validators and
headers join the revisit by its id afterwards, an equi-join whose hot keys Spark splits.

A response counts as earlier if its time is less, or equal with a lesser record id. Status is
`resolved` if the first validator that both sides have agrees (entity tags weakly, else the
modification date), `validator mismatch` if it does not, `no validator` if they share none,
and `no earlier response`. A resolved revisit takes the response's digest and headers, with
those of the revisit over them except for the ones a not-modified answer may not replace;
header names are compared in lower case, and of equal names in one record the first counts.
Revisits without url or time find no response. Each revisit row gives one row; other columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.url_filter import normal_form

SPAN_SECONDS = 7 * 86_400
# Fixed by the rules for updating stored responses in HTTP caching.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
]


def _lower_names(headers: Column) -> Column:
    """Entries with lower-case names, the first of each name."""
    entries = F.transform(
        F.coalesce(F.map_entries(headers), F.array()),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(first)


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers with the permitted ones of the update over them."""
    stored, update = _lower_names(stored), _lower_names(update)
    permitted = F.map_filter(update, lambda k, _: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(permitted, k)), permitted)


def _same_tag(a: Column, b: Column) -> Column:
    return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "")


def last_response(records: DataFrame, span: int = SPAN_SECONDS) -> DataFrame:
    """(record_id, canonical, base_id) of every revisit of (record_id, canonical, record_type,
    captured): the as-of join."""
    rows = records.withColumn("_span", F.floor(F.col("captured") / span))
    responses = rows.filter("record_type = 'response' AND canonical IS NOT NULL AND captured IS NOT NULL")
    lasts = responses.groupBy("canonical", "_span").agg(F.max(F.struct("captured", "record_id")).alias("_last"))
    # One row for each url and span that holds a capture; the carried response is of an earlier one.
    spans = rows.select("canonical", "_span").distinct().join(lasts, ["canonical", "_span"], "left")
    earlier = Window.partitionBy("canonical").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        "canonical", "_span", F.last("_last", ignorenulls=True).over(earlier)["record_id"].alias("_carried")
    )
    inside = Window.partitionBy("canonical", "_span").orderBy("captured", "record_id")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    response_id = F.when(usable & (F.col("record_type") == "response"), F.col("record_id"))
    near = rows.withColumn("_near", F.last(response_id, ignorenulls=True).over(inside))
    revisits = near.filter("record_type = 'revisit'")
    joined = revisits.join(carried, ["canonical", "_span"], "left")
    return joined.select("record_id", "canonical", F.coalesce("_near", "_carried").alias("base_id"))


def resolve(records: DataFrame, span: int = SPAN_SECONDS) -> DataFrame:
    """(record_id, canonical, base_id, status, digest, headers) of every revisit among
    (record_id, record_type, url, captured in seconds, etag, last_modified, digest, headers)."""
    url = F.col("url")
    keyed = records.withColumn("canonical", F.when(url.contains("://"), normal_form(url)))
    narrow = keyed.select("record_id", "canonical", "record_type", "captured")
    based = last_response(narrow, span).select("record_id", "base_id")
    stored = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("base_id"), F.col("etag").alias("b_etag"), F.col("last_modified").alias("b_modified"),
        F.col("digest").alias("b_digest"), F.col("headers").alias("b_headers"),
    )
    revisits = keyed.filter("record_type = 'revisit'")
    joined = revisits.join(based, "record_id", "left").join(stored, "base_id", "left")
    agrees = F.when(F.col("etag").isNotNull() & F.col("b_etag").isNotNull(), _same_tag(F.col("etag"), F.col("b_etag"))).when(
        F.col("last_modified").isNotNull() & F.col("b_modified").isNotNull(), F.col("last_modified") == F.col("b_modified")
    )
    status = (
        F.when(F.col("base_id").isNull(), "no earlier response").when(agrees.isNull(), "no validator")
        .when(agrees, "resolved").otherwise("validator mismatch")
    )
    done = joined.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return done.select(
        "record_id", "canonical", "base_id", "status",
        F.when(resolved, F.col("b_digest")).alias("digest"),
        F.when(resolved, merge_headers(F.col("b_headers"), F.col("headers"))).alias("headers"),
    )

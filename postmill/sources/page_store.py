"""Stored pages: a table of (url, html) that stands in for fetching.

Pages are wide, so they stay where they are read. A narrow frontier goes to them by broadcast
while it is small. Beyond that a Bloom filter of its addresses goes to the scan, so pages that
nobody asked for are dropped there; what was extracted from the others, not the pages, meets the
frontier in a shuffle. Where the pages themselves are wanted by a frontier of any size, a store
laid out by address (`store_pages`, `open_store`) lets the frontier come to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import runtime
from postmill.operators.bloom import BloomFilter


def has_content(html: str = "html"):
    return F.coalesce(F.col(html), F.lit("")) != ""


def store_pages(pages: DataFrame, path: str, buckets: int, url: str = "url") -> None:
    """Lay (url, html) out by address: one file a bucket, rows in the order of the address.

    The only time that pages cross a shuffle; the store must be opened with as many buckets.
    """
    name = f"page_store_{uuid.uuid4().hex}"
    rows = pages.filter(F.col(url).isNotNull()).select(F.col(url).alias("url"), "html")
    rows.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").option("path", path).saveAsTable(name)
    pages.sparkSession.sql(f"DROP TABLE {name}")  # the files of an external table stay


def open_store(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The (url, html) of a store; joins on the address do not shuffle it."""
    name = f"page_store_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (url STRING, html STRING) USING parquet"
        f" CLUSTERED BY (url) SORTED BY (url) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def frontier_fetch(
    frontier: DataFrame, pages: DataFrame, url: str = "url", limit_bytes: int = runtime.BROADCAST_BYTES
) -> DataFrame:
    """Every frontier row with its page; html is null where there is no content.

    A measured small frontier is sent to the pages, which then are not shuffled. A larger one
    is joined with the pages that pass its Bloom filter; of a store opened by `open_store`
    these do not move, of other tables only they do.
    """
    stored = pages.filter(has_content()).select(url, "html")
    frontier = runtime.cut_lineage(frontier)
    if not runtime.fits_broadcast(frontier, limit_bytes):
        wanted = BloomFilter.of(frontier, url, frontier.count())
        return frontier.join(wanted.keep(stored, url), url, "left")
    columns = [*frontier.columns, "html"]
    found = stored.join(F.broadcast(frontier), url).select(columns)
    missing = _unanswered(frontier, pages, url, limit_bytes).withColumn("html", F.lit(None).cast("string"))
    return found.unionByName(missing)


def missing_pages(
    frontier: DataFrame, pages: DataFrame, url: str = "url", limit_bytes: int = runtime.BROADCAST_BYTES
) -> DataFrame:
    """Frontier rows no stored page answers."""
    return _unanswered(runtime.cut_lineage(frontier), pages, url, limit_bytes)


def _unanswered(frontier: DataFrame, pages: DataFrame, url: str, limit_bytes: int) -> DataFrame:
    """`frontier` is materialised. Only addresses of wanted pages meet it, one row each."""
    stored = of_wanted(frontier, pages.filter(has_content()).select(url), url, limit_bytes)
    found = stored.select(url).distinct()
    return frontier.join(found, url, "left_anti")


def of_wanted(wanted: DataFrame, pages: DataFrame, key: str, limit_bytes: int = runtime.BROADCAST_BYTES) -> DataFrame:
    """The pages whose key is in the materialised `wanted`, without a shuffle of either: exact
    while the keys are small enough to be sent, else with some pages nobody wants."""
    if runtime.fits_broadcast(wanted.select(key), limit_bytes):
        return pages.join(F.broadcast(wanted.select(key).distinct()), key, "left_semi")
    return BloomFilter.of(wanted, key, wanted.count()).keep(pages, key)


def extract_for(
    wanted: DataFrame,
    pages: DataFrame,
    key: str,
    extract: Callable[[DataFrame], DataFrame],
    limit_bytes: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """`wanted` joined on `key` with what `extract` reads out of its pages.

    `wanted` is a narrow, materialised table, `pages` has `key` and html, and `extract`
    keeps `key` and drops html. Pages are selected before they are parsed, by the keys while
    these are small, else by their Bloom filter, and only results move. A page stored several
    times counts once.
    """
    stored = of_wanted(wanted, pages.filter(has_content()), key, limit_bytes)
    return wanted.join(one_per_key(extract(stored), key), key, "inner")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the least by its other columns; copies collapse before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")

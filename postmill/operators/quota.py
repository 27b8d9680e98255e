"""Page-granular quotas and stop rules over (position, page, n).

`n` is the number of new postings on a page; pages of a position are numbered from 0
without gaps. A position may hold any share of the pages: running sums work on blocks of
pages, and the run of empty pages is found with windows no longer than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.fixed_values import MAX_EMPTY_PAGES

BLOCK = 65_536


def running_before(counts: DataFrame, value: str = "n", name: str = "before", block: int = BLOCK) -> DataFrame:
    """Sum of `value` over the earlier pages of the position.

    Inside a block by a window, between blocks by a window over one row per block.
    """
    blocked = counts.withColumn("_block", F.floor(F.col("page") / block))
    inside = W.partitionBy("position", "_block").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("position").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("position", "_block").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, ["position", "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_block", "_inside", "_offset")
    )


def position_quota(counts: DataFrame, cap: int, block: int = BLOCK) -> DataFrame:
    """Pages taken while fewer than `cap` postings were kept before them.

    A page is taken whole, so the total may pass the cap.
    """
    return running_before(counts, block=block).filter(F.col("before") < cap)


def total_quota(
    counts: DataFrame, order: str, cap_position: int, cap_total: int, block: int = BLOCK
) -> DataFrame:
    """Pages taken under a cap per position and one over all positions in order.

    Positions before the one that reaches the total cap are cut by their own cap alone,
    that one is cut by what remains, and later ones take nothing. So one running sum over
    the position totals (a row per search phrase) replaces a loop.
    """
    capped = position_quota(counts, cap_position, block)
    earlier = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    room = (
        capped.groupBy(*dict.fromkeys(["position", order])).agg(F.sum("n").alias("_n"))
        .withColumn("_room", F.lit(cap_total) - F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select("position", "_room")
    )
    return capped.join(room, "position").filter(F.col("before") < F.col("_room")).drop("_room")


def _stop_pages(counts: DataFrame, ends: Column) -> DataFrame:
    return counts.filter(ends).groupBy("position").agg(F.min("page").alias("_stop"))


def empty_run_stop(counts: DataFrame, run: int = MAX_EMPTY_PAGES, block: int = BLOCK) -> DataFrame:
    """Pages up to the first page that ends a run of `run` pages without new postings.

    Each block also reads the run - 1 pages before it, so runs across blocks count.
    """
    homes = F.sequence(F.floor(F.col("page") / block), F.floor((F.col("page") + run - 1) / block))
    recent = W.partitionBy("position", "_block").orderBy("page").rowsBetween(1 - run, 0)
    runs = (
        counts.select("position", "page", "n", F.explode(homes).alias("_block"))
        .withColumn("_empty", F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).over(recent))
    )
    stops = _stop_pages(runs, F.col("_empty") == run)
    return (
        counts.join(stops, "position", "left")
        .filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
        .drop("_stop")
    )


def failed_page_stop(counts: DataFrame, failed: Column) -> DataFrame:
    """Pages before the first failed one.

    A failed page is tried again without moving on, and a stored page fails every try, so
    the position ends there.
    """
    stops = _stop_pages(counts.withColumn("_failed", failed), F.col("_failed"))
    return (
        counts.join(stops, "position", "left")
        .filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
        .drop("_stop")
    )


def pages_used(
    counts: DataFrame,
    order: str,
    cap_position: int,
    cap_total: int,
    failed: Column | None = None,
    run: int = MAX_EMPTY_PAGES,
    block: int = BLOCK,
) -> DataFrame:
    """All stop rules together, for counts that do not depend on the pages dropped."""
    used = counts if failed is None else failed_page_stop(counts, failed)
    used = empty_run_stop(used, run, block)
    return total_quota(used, order, cap_position, cap_total, block)


def short_position_used(
    counts: DataFrame, cap: int, failed: Column, run: int = MAX_EMPTY_PAGES
) -> DataFrame:
    """The same rules for positions known to have at most BLOCK pages: one window each."""
    ordered = W.partitionBy("position").orderBy("page")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    recent = ordered.rowsBetween(1 - run, 0)
    return (
        counts.withColumn("_ends", F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).over(recent) == run)
        .withColumns({
            "_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "_ended": F.coalesce(F.max("_ends").over(earlier), F.lit(False)),
            "_failed": F.max(failed).over(ordered.rowsBetween(W.unboundedPreceding, 0)),
        })
        .filter((F.col("_before") < cap) & ~F.col("_ended") & ~F.col("_failed"))
        .drop("_ends", "_before", "_ended", "_failed")
    )


def failed_page_reached(
    counts: DataFrame, used: DataFrame, cap: int, failed: Column, run: int = MAX_EMPTY_PAGES
) -> DataFrame:
    """(position, page) of positions that ended because a page failed, not by another rule:
    all pages before it were used, and neither their sum nor their last pages ended the walk."""
    first = counts.filter(failed).groupBy("position").agg(F.min("page").alias("page"))
    walked = used.groupBy("position").agg(
        F.count(F.lit(1)).alias("_pages"), F.sum("n").alias("_sum"), F.max(F.when(F.col("n") > 0, F.col("page"))).alias("_last")
    )
    pages, last = F.coalesce("_pages", F.lit(0)), F.coalesce("_last", F.lit(-1))
    return (
        first.join(walked, "position", "left")
        .filter((pages == F.col("page")) & (F.coalesce("_sum", F.lit(0)) < cap) & (pages - 1 - last < run))
        .select("position", "page")
    )

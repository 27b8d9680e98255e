"""Run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.operators.quota import BLOCK, running_before


def page_counts(postings: DataFrame) -> DataFrame:
    """New postings per page."""
    return postings.groupBy("position", "page").agg(F.count(F.lit(1)).alias("n"))


def progress_metrics(counts: DataFrame, order: str = "position", block: int = BLOCK) -> DataFrame:
    """Per page: new postings, running total of the position, running total of the run."""
    earlier = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.groupBy(*dict.fromkeys(["position", order])).agg(F.sum("n").alias("_n"))
        .withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select("position", "_earlier")
    )
    return (
        running_before(counts, block=block)
        .join(offsets, "position")
        .withColumn("position_total", F.col("before") + F.col("n"))
        .withColumn("run_total", F.col("_earlier") + F.col("position_total"))
        .drop("before", "_earlier")
    )


def token_accounting(postings: DataFrame, by: str = "source", cost: str = "token_cost") -> DataFrame:
    return postings.groupBy(by).agg(F.coalesce(F.sum(cost), F.lit(0)).alias("used_tokens"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))

"""Tables of the pages a run asks for.

A frontier is generated from the search settings: phrases are exploded, and each phrase
explodes its page numbers, so nothing is joined to build it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.config import BoardASearch, BoardBSearch
from postmill.functions import addresses


def position_split(df: DataFrame, positions: Column) -> DataFrame:
    """One row per phrase of a comma list, in order and untrimmed."""
    return df.select("*", F.posexplode(F.split(positions, ",")).alias("position_no", "position"))


def frontier_cross(positions: DataFrame, first_page: int, last_page: int) -> DataFrame:
    """Every phrase with every page number of the range."""
    return positions.select("*", F.explode(F.sequence(F.lit(first_page), F.lit(last_page))).alias("page"))


def search_frontier_a(
    spark: SparkSession, search: BoardASearch, first_page: int = 0, last_page: int = 0
) -> DataFrame:
    """(position_no, position, page, url)"""
    one = spark.range(1).select(F.lit(search.positions).alias("positions"))
    phrases = position_split(one, F.col("positions")).drop("positions")
    return with_search_url_a(frontier_cross(phrases, first_page, last_page), search)


def with_search_url_a(frontier: DataFrame, search: BoardASearch) -> DataFrame:
    start = F.col("page") * fixed.PAGE_OFFSET
    return frontier.withColumn("url", addresses.board_a_search_url(start, F.col("position"), search))


def search_frontier_b(spark: SparkSession, search: BoardBSearch) -> DataFrame:
    """(position_no, position, url)"""
    one = spark.range(1).select(F.lit(search.positions).alias("positions"))
    phrases = position_split(one, F.col("positions")).drop("positions")
    return with_search_url_b(phrases, search)


def with_search_url_b(phrases: DataFrame, search: BoardBSearch) -> DataFrame:
    return phrases.withColumn(
        "url",
        addresses.board_b_search_url(
            F.col("position"), F.lit(search.location), search.max_age_days, search.remote_only, search.base_url
        ),
    )

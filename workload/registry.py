"""Registration of queries and small helpers they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.runtime import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale factor, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables; without SQL only its rows are counted."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(Tables(spark, sf_dir))

        key = name or function.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/workload-{uuid.uuid4().hex}"


def utc(column: str) -> Column:
    """A stored timestamp without zone as UTC."""
    return F.col(column).cast("timestamp")


def millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


SQL_MILLIS = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"

# Unicode whitespace, for an engine whose \s is ASCII.
SQL_SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_decode(text: str) -> str:
    for name, char in (
        ("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")
    ):
        text = rf"regexp_replace({text}, '&{name}(;|\b)', '{char}', 'g')"
    return text


def sql_drop_markup(html: str, separator: str) -> str:
    pattern = (
        r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[/!?]?[a-zA-Z][^>]*>"
    )
    return f"regexp_replace({html}, '{pattern}', '{separator}', 'g')"


def sql_text(html: str) -> str:
    return sql_collapse(sql_decode(sql_drop_markup(html, " ")))


def sql_element_text(html: str) -> str:
    return sql_strip(sql_decode(sql_drop_markup(html, "")))

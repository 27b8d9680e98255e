"""The sorted report over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed


def array_to_text(values: Column) -> Column:
    return F.array_join(values, ", ")


def report_projection(postings: DataFrame) -> DataFrame:
    """Report columns in order; a column the postings lack is ''."""
    present = dict(postings.dtypes)
    return postings.select([
        F.lit("").alias(c) if c not in present
        else array_to_text(F.col(c)).alias(c) if present[c].startswith("array")
        else F.col(c)
        for c in fixed.REPORT_COLUMNS
    ])


def report_sort(postings: DataFrame, order: list[str]) -> DataFrame:
    """Newest first, nulls last. `order` keeps ties in input order, and, being unique,
    lets the range partitioning split any number of equal dates."""
    return postings.orderBy(
        F.desc_nulls_last("date_analyzed"), F.desc_nulls_last("posted_time"), *[F.asc(c) for c in order]
    )


def title_of(name: str) -> str:
    return " ".join(word.capitalize() for word in name.replace("_", " ").split())


def column_titles(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: title_of(c) for c in df.columns})


def column_title(name: Column) -> Column:
    """The same over a column of names."""
    words = F.filter(F.split(F.replace(name, F.lit("_"), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))),
        " ",
    )


def language_flag(lang: Column) -> Column:
    """Set languages other than English are marked."""
    return F.coalesce((lang != "") & (F.lower(lang) != "en"), F.lit(False))


def language_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "title_flag": language_flag(F.col("title_lang")),
        "description_flag": language_flag(F.col("description_lang")),
    })


def link_label(url: Column) -> Column:
    """What a link cell shows; the address itself stays in its own column."""
    return F.when(url != "", F.lit("Link"))


def column_width_profile(report: DataFrame, link_column: str = "url") -> DataFrame:
    """Display width per column from one aggregation over all of them."""
    longest = report.agg(*[
        F.greatest(
            F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("None")))),
            F.lit(len(title_of(c))),
        ).alias(c)
        for c in report.columns
    ])
    longest = longest.unpivot([], report.columns, "column_name", "longest")
    return longest.select(
        "column_name",
        F.when(F.col("column_name") == link_column, F.lit(fixed.LINK_COLUMN_WIDTH))
        .otherwise(F.least(F.col("longest") + 2, F.lit(fixed.MAX_COLUMN_WIDTH)))
        .alias("width"),
    )


def boards_union(*boards: DataFrame) -> DataFrame:
    """One table of postings; rows are told apart by `source`."""
    union = boards[0]
    for board in boards[1:]:
        union = union.unionByName(board, allowMissingColumns=True)
    return union

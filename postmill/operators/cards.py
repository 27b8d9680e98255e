"""Posting cards and detail pages of board A."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions import addresses, dates, markup

_CARD = (
    rf"<li\b[^>]*>{markup.GAP}<div\s(?:[^>]*?\s)?{markup.class_token(fixed.CARD_CLASS)}[^>]*>"
)


def card_elements(html: Column) -> Column:
    """Inner markup of every `li > div.base-card`, in document order."""
    pieces = F.split(html, rf"(?=(?is){_CARD})")
    openings = F.filter(pieces, lambda p: p.rlike(rf"(?is)\A{_CARD}"))
    return F.transform(
        openings,
        lambda p: markup.balanced(F.regexp_replace(p, rf"(?is)\A{_CARD}", ""), F.lit("div")),
    )


def card_fields(card: Column) -> Column:
    """The texts of one card, without its markup."""
    return F.struct(
        markup.first_href(card, fixed.LINK_CLASS_PART).alias("url"),
        markup.first_text(card, fixed.TITLE_CLASS_PART).alias("title"),
        markup.first_text(card, fixed.COMPANY_CLASS_PART).alias("company"),
        markup.first_text(card, fixed.AGE_CLASS_PART).alias("age"),
        markup.first_text(card, fixed.LOCATION_CLASS_PART).alias("location"),
    )


def page_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with `cards`, an array of card texts, in place of html."""
    return pages.withColumn("cards", F.transform(card_elements(F.col(html)), card_fields)).drop(html)


def card_explode(pages: DataFrame) -> DataFrame:
    """One row per card of pages that went through page_cards."""
    return pages.select(
        *[c for c in pages.columns if c != "cards"], F.posexplode("cards").alias("card", "_c")
    ).select(*[c for c in pages.columns if c != "cards"], "card", "_c.*")


def card_postings(cards: DataFrame, as_of) -> DataFrame:
    """Cards with id, posting time and source; an unusable age gives a null time."""
    return cards.withColumns({
        "job_id": addresses.posting_id(F.col("url")),
        "posted_time": dates.relative_age(F.col("age"), as_of),
        "date_analyzed": dates.as_timestamp(as_of),
        "source": F.lit(fixed.SOURCE_A),
    })


def description_block(html: Column) -> Column:
    """Text of the first `[class*=description] > section > div`, whitespace collapsed."""
    nested = rf"{markup.open_tag(markup.class_contains(fixed.DESCRIPTION_CLASS_PART))}{markup.GAP}<section\b[^>]*>{markup.GAP}<div\b[^>]*>"
    rest = F.regexp_extract(html, rf"(?s){nested}(.*)\z", 2)
    inner = markup.balanced(rest, F.lit("div"))
    return markup.collapse(markup.decode_entities(markup.drop_markup(inner, "")))


def criteria_items(html: Column) -> Column:
    """array<struct<label,value>> of the criteria list; items without both are skipped."""
    inner = markup.first_inner(html, markup.class_token(fixed.CRITERIA_LIST_CLASS), "ul")
    items = F.split(F.coalesce(inner, F.lit("")), r"(?i)(?=<li[\s>])")

    def read(item: Column, name: str) -> Column:
        return markup.first_element_text(item, markup.class_token(name))

    pairs = F.transform(
        items,
        lambda i: F.struct(
            read(i, fixed.CRITERIA_LABEL_CLASS).alias("label"),
            read(i, fixed.CRITERIA_VALUE_CLASS).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p["label"].isNotNull() & p["value"].isNotNull())


def criteria_pivot(items: Column) -> dict[str, Column]:
    """The four known criteria as columns; the last item of a label wins, absent is ''.

    Works inside the row: a page holds its whole list, so nothing has to be grouped.
    """

    def last_value(label: str) -> Column:
        named = F.filter(items, lambda p: p["label"] == label)
        return F.coalesce(F.try_element_at(named, F.lit(-1))["value"], F.lit(""))

    return {name: last_value(label) for label, name in fixed.CRITERIA_FIELDS.items()}


def apply_flag(html: Column) -> Column:
    """'Yes' when the off-site apply icon is absent."""
    icon = rf"""(?is)<icon\b[^>]*\bdata-svg-class-name\s*=\s*["']{fixed.OFFSITE_ICON}["']"""
    return F.when(html.rlike(icon), "No").otherwise("Yes")


def detail_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Detail pages reduced to description, criteria and apply flag."""
    read = pages.withColumns({
        "description": description_block(F.col(html)),
        "_items": criteria_items(F.col(html)),
        "easy_apply": apply_flag(F.col(html)),
    })
    return read.withColumns(criteria_pivot(F.col("_items"))).drop("_items", html)

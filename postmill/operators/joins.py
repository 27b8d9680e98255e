"""Joins against the postings kept so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import runtime
from postmill.functions.markup import strip

ID_KEY, PAIR_KEY = KEYS = "_id_key", "_pair_key"


def normal(text: Column) -> Column:
    """The form titles and companies are compared in; null compares as ''."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def identity_keys(title: str = "title", company: str = "company", job_id: str = "job_id") -> dict[str, Column]:
    """Two keys make postings the same: the id, or the pair of title and company."""
    return {
        ID_KEY: F.coalesce(F.col(job_id), F.lit("")),
        PAIR_KEY: F.struct(normal(F.col(title)).alias("t"), normal(F.col(company)).alias("c")),
    }


def anti_join_prior(
    cards: DataFrame,
    prior: DataFrame,
    rows: int | None = None,
    hot_min_rows: int = runtime.HOT_MIN_ROWS,
    limit_bytes: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """Drop cards that share an id or a (title, company) with a kept posting.

    Two equality anti joins; one join on "id or pair" would compare all rows with all.

    Pass `rows`, their number, when the cards are a checkpointed table. Then their keys
    are measured: while they are small they go to the kept side by broadcast, which is
    read but not shuffled. Beyond that the kept side is reduced to one row per key and
    shuffled, and keys holding much of the cards are kept out of the shuffle.
    """
    keyed = cards.withColumns(identity_keys())
    kept = prior.withColumns(identity_keys())
    small = rows is not None and runtime.fits_broadcast(keyed.select(ID_KEY, PAIR_KEY), limit_bytes)
    hot = {key: None if small else runtime.hot_keys(keyed, key, rows or 0, hot_min_rows) for key in KEYS}
    left = keyed
    for key in KEYS:
        taken = kept.select(key)
        if small:
            taken = taken.join(F.broadcast(keyed.select(key).distinct()), key, "left_semi")
        if hot[key] is not None and left is not keyed:
            left = runtime.cut_lineage(left)
        left = runtime.split_by_membership(left, taken.distinct(), key, hot[key])
    return left.select(cards.columns)


def card_detail_join(cards: DataFrame, details: DataFrame, key: str = "job_id") -> DataFrame:
    """Cards with their detail page; cards without one are dropped."""
    return cards.join(details, key, "inner")

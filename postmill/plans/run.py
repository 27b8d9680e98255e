"""What a run gives back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """`postings` are the new ones, in the stored schema plus `token_cost`."""

    postings: DataFrame
    quarantined: DataFrame
    progress: DataFrame | None = None


def quarantine_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Quarantined rows of several steps; columns whose types differ become text."""
    tables = [first, *others]
    types: dict[str, set[str]] = {}
    for table in tables:
        for name, kind in table.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = [name for name, kinds in types.items() if len(kinds) > 1]
    out = None
    for table in tables:
        as_text = table.withColumns({n: F.col(n).cast("string") for n in mixed if n in table.columns})
        out = as_text if out is None else out.unionByName(as_text, allowMissingColumns=True)
    return out

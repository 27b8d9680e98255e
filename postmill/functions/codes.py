"""Names to codes. An unknown name is null, for the caller to quarantine."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_lookup(codes: dict, name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return F.element_at(table, name)

"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`.

    Inside lambdas and CASE branches Spark does not share common subexpressions; a lambda
    over a one-element array does.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

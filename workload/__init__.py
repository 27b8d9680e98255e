"""Registered queries over the given tables, each with the SQL that should agree."""

from workload.registry import ORACLES, QUERIES
from workload import boards, dedup, language, markup, pages, quotas, reports, scalars, storage  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]

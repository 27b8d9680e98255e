"""Job-posting analytics as Spark jobs."""

from postmill.config import BoardASearch, BoardBSearch
from postmill.functions.language import ProfileDetector, StopWordDetector
from postmill.schema import POSTING_SCHEMA, STORED_SCHEMA

__all__ = [
    "POSTING_SCHEMA",
    "STORED_SCHEMA",
    "BoardASearch",
    "BoardBSearch",
    "ProfileDetector",
    "StopWordDetector",
]

"""Named end-to-end queries (one per operator) and their oracle SQL."""

from .registry import ORACLE, QUERIES
from . import (catalogue_queries, display_queries, format_queries, hit_queries, lc_queries, people_queries,  # noqa: F401
               search_queries, sky_queries, stream_queries)  # noqa: F401  (registers)

__all__ = ["QUERIES", "ORACLE"]

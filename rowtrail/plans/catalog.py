"""All named queries and their SQL counterparts."""

from rowtrail.plans import (column_queries, influence_queries, lineage_queries, program_queries,  # noqa: F401
                            trace_queries)
from rowtrail.plans.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

"""All queries of the measurement engine by name, with their SQL twins."""

from __future__ import annotations

from spanforge.plans import cloud_queries, forest_queries, job_queries, measure_queries, plane_queries, points_queries, quality_queries, rule_queries, state_queries, stream_queries  # noqa: F401  they register their queries
from spanforge.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

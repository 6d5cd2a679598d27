"""The registered queries of the library and their SQL."""

from __future__ import annotations

from kickframe.plans import aggregate_queries, analytic_queries, frame_queries, relational_queries, scalar_queries, series_queries, state_queries, stream_queries, vision_queries  # noqa: F401
from kickframe.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "segment_error"

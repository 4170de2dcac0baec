"""The registered queries over the driver's tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from helixframe.plans import align_queries, model_queries, profile_queries, resample_queries, sequence_queries, vector_queries  # noqa: F401  they register
from helixframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

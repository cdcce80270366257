"""Registered queries of the library's own operators."""

from creatorlake.plans import aggregates, associations, curves, evaluation, gates, inference, iterative, modelling, more, relational, sequences, series, statistics, structure, text  # noqa: F401
from creatorlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

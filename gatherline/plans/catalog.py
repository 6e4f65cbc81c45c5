"""Loads every query module, which registers its queries."""

from gatherline.plans import q_agg, q_joins, q_learn, q_rows, q_sources, q_stats, q_streams, q_text, q_windows  # noqa: F401
from gatherline.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

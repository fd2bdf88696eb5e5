"""Operators end to end."""

from .recommend import all_queries, candidates, recommended

__all__ = ["all_queries", "candidates", "recommended"]

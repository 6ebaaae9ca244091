"""All queries of the library."""

from . import full_queries, grid_queries, mixture_queries, relation_queries, report_queries, slice_queries, splat_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

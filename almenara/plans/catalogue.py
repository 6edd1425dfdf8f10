"""Importing the plan modules fills the registry."""

from almenara.plans import access_queries, document_queries, geo_queries, inequality_queries, procurement_queries, quality_queries, retrieval_queries, series_queries, source_queries  # noqa: F401
from almenara.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

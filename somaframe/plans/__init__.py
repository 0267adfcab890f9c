"""Queries over the sample tables, by area. Importing this package fills the registry."""

from somaframe.plans import beat_queries, breath_queries, frequency_queries, ingest_queries, model_queries, signal_queries, study_queries, table_queries, window_queries  # noqa: F401
from somaframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

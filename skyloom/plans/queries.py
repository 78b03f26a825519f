"""Importing this module registers every query of the library outside ``llm``."""

from skyloom.plans import q_aggregates, q_algebra, q_io_models, q_joins, q_sampling, q_spatial, q_timeseries  # noqa: F401
from skyloom.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

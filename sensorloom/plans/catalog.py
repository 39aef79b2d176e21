"""All registered queries."""

from . import batches, messages, policies, readings, rollups, series, sinks, streams  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""Registered queries: each a Spark job over the whole sample tables with the SQL that checks it."""

from tickloom.workload.base import ORACLES, QUERIES
from tickloom.workload import bars, books, judge, stores, trade  # noqa: F401  (registration)

__all__ = ["ORACLES", "QUERIES"]

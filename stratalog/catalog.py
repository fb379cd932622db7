"""All queries of the engine."""

from .plans import checker, control, encodings, journal, ranges, reads, storage, topology, transactions  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

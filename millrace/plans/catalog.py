"""All queries of the engine and the SQL that checks them."""

from millrace.plans import live, market, records, sequences, texts  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

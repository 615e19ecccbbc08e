"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import flows, folds, measures, product, relational, text, timed, timeline  # noqa: F401  they register their queries
from tessera.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""All retail queries by name, and the SQL that says the same."""

from __future__ import annotations

from . import core_queries, model_queries, recall_queries, series_queries  # noqa: F401, I001
from . import more_queries  # noqa: F401  it takes SQL from the others
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Registry of the engine's own queries and of the SQL that gives the same rows."""

from __future__ import annotations

from . import changes, filters, rank, stored, text, vector
from .base import ORACLE_SQL, QUERIES
from .text import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "changes", "filters", "flagship", "rank", "stored", "text", "vector"]

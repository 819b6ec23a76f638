"""Every registered query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from . import corpus, detection, evaluation  # noqa: F401  corpus and evaluation add their queries to the registry

QUERIES: dict = detection.QUERIES
ORACLE_SQL: dict[str, str] = detection.ORACLE_SQL

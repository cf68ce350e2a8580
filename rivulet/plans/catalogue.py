"""All named queries, and SQL that gives the same rows."""

from __future__ import annotations

from . import data, detection, models, operations, projections, states
from .tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "data", "detection", "models", "operations", "projections", "states"]

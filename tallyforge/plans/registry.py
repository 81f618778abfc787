"""All queries of the engine and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from . import aggregation, archives, assembly, costing, joining, normalizing, persisting, routing, selection, sequencing, storing, structure, surface
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregation", "archives", "assembly", "costing", "joining", "normalizing", "persisting", "routing", "selection", "sequencing", "storing", "structure", "surface"]

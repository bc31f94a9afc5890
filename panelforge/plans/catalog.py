"""Names of the registered queries, their callables and their SQL."""

from __future__ import annotations

from panelforge.plans import models, oracles, queries

QUERIES = queries.QUERIES | models.QUERIES
ORACLES = oracles.ORACLES | models.ORACLES
FLAGSHIP = "gap_clusters_fixed"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

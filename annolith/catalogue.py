"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from .plans import catalog_a, catalog_b, catalog_c, catalog_d, catalog_e

QUERIES = {**catalog_a.QUERIES, **catalog_b.QUERIES, **catalog_c.QUERIES, **catalog_d.QUERIES, **catalog_e.QUERIES}
ORACLES = {**catalog_a.ORACLES, **catalog_b.ORACLES, **catalog_c.ORACLES, **catalog_d.ORACLES, **catalog_e.ORACLES}

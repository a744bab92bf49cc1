"""All queries outside the removable subpackage."""

from __future__ import annotations

from . import Catalog, listings, matrices, scores, signals, tables

catalog = Catalog()
for part in (matrices, scores, listings, tables, signals):
    catalog.update(part.catalog)

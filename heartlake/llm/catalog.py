"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from ..catalog import Catalog
from . import cross_split_queries, sampling_queries, text_queries, vector_queries

catalog = Catalog()
for part in (cross_split_queries, sampling_queries, text_queries, vector_queries):
    catalog.update(part.catalog)

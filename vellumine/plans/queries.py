"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from ..functions import patterns as P
from . import cleaning, documents, overlap, sources

QUERIES, SQL = {}, {}
for _module in (cleaning, overlap, documents, sources):
    QUERIES |= _module.QUERIES
    SQL |= {name: sql.replace(P.WS, P.WS_RANGES) for name, sql in _module.SQL.items()}
